"""Behaviour of the engine on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.errors import IndexNotReady, InvalidCursor, ModelError, NotFilterable, NotSortable, OperatorNotAllowed, QueryError
from pagewright.model import Backend, Entity, Filter, Join, Mode, Op, PagedQuery, Registry, ReindexMode, Searchable, Sort
from pagewright.plans.engine import Engine, Options
from pagewright.plans.ranking import HybridOptions, TextOptions
from pagewright.sources.embeddings import FunctionEmbedding, HashEmbedding
from pagewright.sources.index import IndexStore, plan_changes
from pagewright.sources.jobs import JobQueue
from pagewright.sources.tables import frames
from pagewright.streaming import maintenance as upkeep
from pagewright import cli

ANY = frozenset()
WIDGET = Entity("widgets", ("id",), (Searchable("name"), Searchable("sku")), filterable={"name": ANY, "sku": frozenset({Op.EQ}), "stock": ANY, "made": ANY}, sortable=frozenset({"name", "stock", "made"}))


@pytest.fixture(scope="module")
def widgets(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a", "Blue Widget", "BLUE-001", 5, day), ("b", "Red Widget", "RED-001", None, day), ("c", "Greenish Hue", "GRN-002", 7, None), ("d", "50%_off\\x", "OFF", 5, day), ("e", None, None, 5, day), ("f", "", "", -1, day)]
    return spark.createDataFrame(rows, "id string, name string, sku string, stock int, made timestamp")


@pytest.fixture(scope="module")
def engine(spark, widgets):
    return Engine(spark, frames({"widgets": widgets}), Registry(WIDGET))


def ids(page):
    return [r["id"] for r in (page.items if isinstance(page.items, list) else page.items.collect())]


def find(engine, entity=WIDGET, **query):
    return engine.search_offset(entity, PagedQuery(**query))


def test_filters(engine):
    def by(*filters):
        return sorted(ids(find(engine, filters=filters)))

    assert by(Filter("stock", Op.EQ, "5")) == ["a", "d", "e"]
    assert by(Filter("stock", Op.NEQ, "5")) == ["c", "f"]
    assert by(Filter("stock", Op.IN, " 5 ,7,")) == ["a", "c", "d", "e"]
    assert by(Filter("stock", Op.IS_NULL)) == ["b"]
    assert by(Filter("name", Op.NOT_NULL), Filter("stock", Op.GT, "0")) == ["a", "c", "d"]
    assert by(Filter("name", Op.CONTAINS, "WIDGET")) == ["a", "b"]
    for literal in ("%", "_", "\\"):
        assert by(Filter("name", Op.CONTAINS, literal)) == ["d"]


def test_filter_errors(engine):
    for clause, error in ((Filter("id", Op.EQ, "a"), NotFilterable), (Filter("sku", Op.CONTAINS, "a"), OperatorNotAllowed), (Filter("stock", Op.IN, " , "), QueryError), (Filter("stock", Op.EQ, "x"), QueryError)):
        with pytest.raises(error):
            find(engine, filters=(clause,))


def test_pages_and_totals(engine):
    page = find(engine, sort=(Sort("stock"),), limit=4)
    assert ids(page) == ["f", "a", "d", "e"] and (page.total, page.has_more, page.has_prev) == (6, True, False)
    last = find(engine, sort=(Sort("stock"),), limit=4, page=1)
    assert ids(last) == ["c", "b"] and (last.has_more, last.has_prev) == (False, True)
    assert find(engine, page=9).total == 6 and ids(find(engine, page=9)) == []
    assert ids(find(engine, sort=(Sort("stock", True),), limit=2)) == ["b", "c"]
    assert find(engine, count=False).total is None


def test_query_errors(engine, spark, widgets):
    with pytest.raises(NotSortable):
        find(engine, sort=(Sort("sku"),))
    for bad in (dict(limit=-1), dict(page=-1), dict(mode=Mode.CURSOR)):
        with pytest.raises(QueryError):
            find(engine, **bad)
    with pytest.raises(QueryError):
        engine.search_cursor(WIDGET, PagedQuery())
    with pytest.raises(ModelError, match="lacks"):
        find(Engine(spark, frames({"widgets": widgets.drop("sku")}), Registry()))


def walk(engine, entity, key, **query):
    """All rows forward, then back from the end; every page's rows."""
    seen, token, pages = [], None, 0
    while True:
        page = engine.search_cursor(entity, PagedQuery(Mode.CURSOR, cursor=token, **query))
        seen += [tuple(r[k] for k in key) for r in page.items]
        pages += 1
        if not page.has_more:
            break
        token = page.next_cursor
    back, token = [], page.prev_cursor
    while token:
        page = engine.search_cursor(entity, PagedQuery(Mode.CURSOR, cursor=token, backward=True, **query))
        back = [tuple(r[k] for k in key) for r in page.items] + back
        if not page.has_prev:
            break
        token = page.prev_cursor
    return seen, back, pages


@pytest.mark.parametrize("sort", [(), (Sort("stock"),), (Sort("stock", True),), (Sort("made", True), Sort("stock")), (Sort("name"), Sort("stock", True))])
def test_keyset_visits_each_row_once(engine, sort):
    seen, back, _ = walk(engine, WIDGET, ["id"], sort=sort, limit=2)
    whole = engine.search_cursor(WIDGET, PagedQuery(Mode.CURSOR, sort=sort, limit=50))
    assert [x for (x,) in seen] == ids(whole) and len(set(seen)) == 6
    assert back == seen[: len(back)] and len(back) == 4


def test_keyset_composite(spark):
    rows = spark.createDataFrame([(t, k, "same") for t in ("x", "y") for k in range(5)], "tenant string, id long, title string")
    entity = Entity("docs", ("tenant", "id"), sortable=frozenset({"title"}))
    engine = Engine(spark, frames({"docs": rows}), Registry(entity))
    seen, back, pages = walk(engine, entity, ["tenant", "id"], sort=(Sort("title", True),), limit=3)
    assert len(seen) == len(set(seen)) == 10 and seen == sorted(seen, reverse=True) and pages == 4 and back == seen[:9]


def test_cursor_is_bound_to_its_query(engine):
    page = engine.search_cursor(WIDGET, PagedQuery(Mode.CURSOR, limit=1, filters=(Filter("stock", Op.EQ, "5"),)))
    for other in (dict(filters=(Filter("stock", Op.EQ, "7"),)), dict(sort=(Sort("name"),)), dict(search="blue")):
        with pytest.raises(InvalidCursor):
            engine.search_cursor(WIDGET, PagedQuery(Mode.CURSOR, limit=1, cursor=page.next_cursor, **other))


def test_trigram(engine):
    assert ids(find(engine, search="blue")) == ["a"]
    assert ids(find(engine, search=" widgte ")) == ["a", "b"]
    assert ids(find(engine, search="widget", filters=(Filter("stock", Op.IS_NULL),))) == ["b"]
    assert ids(find(engine, search="002", search_fields=("NAME",))) == [] and ids(find(engine, search="grn-002", search_fields=("sku",))) == ["c"]
    assert ids(find(engine, search="blue", search_fields=("nothing",))) == []
    page = find(engine, search="widget", limit=1, page=1)
    assert ids(page) == ["b"] and page.total == 2


def test_candidates(engine):
    assert ids(find(engine, search="widget", candidates=["b", "b", "zz"])) == ["b"]
    assert ids(find(engine, search="widget", candidates=[])) == []
    assert ids(find(engine, search="widget", candidates=["a", "b"], filters=(Filter("stock", Op.EQ, "5"),))) == ["a"]
    assert len(ids(find(engine, candidates=[]))) == 6  # only a search is restricted


def test_search_joins(spark):
    tag = Entity("tags", ("id",), (Searchable("label"),))
    item = Entity("items", ("id",), (Searchable("description"),), (Join("Tags", tag, many=True, foreign_key="item_id"),))
    order = Entity("orders", ("id",), (Searchable("customer"),), (Join("Items", item, many=True, foreign_key="order_id", where="NOT coalesce({c}.hidden, false)"),))
    tables = {
        "orders": spark.createDataFrame([("o1", "Bob"), ("o2", "Alice")], "id string, customer string"),
        "items": spark.createDataFrame([("i1", "o1", "Black umbrella", None), ("i2", "o2", "Notebook", False), ("i3", "o2", "umbrella", True)], "id string, order_id string, description string, hidden boolean"),
        "tags": spark.createDataFrame([("t1", "i2", "fragile")], "id string, item_id string, label string"),
    }
    engine = Engine(spark, frames(tables), Registry(order))
    assert ids(find(engine, order, search="umbrella")) == ["o1"]
    assert ids(find(engine, order, search="fragile")) == ["o2"]
    assert ids(find(engine, order, search="fragile", search_fields=("tags.label",))) == ["o2"]
    assert ids(find(engine, order, search="bob")) == ["o1"]


DOC = Entity("docs", ("id",), (Searchable("title", Backend.FULL_TEXT, 2.0, config="english"), Searchable("body", Backend.FULL_TEXT, 0.5, config="english")), filterable={"id": ANY})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("1", "Reindexing guide", "how to"), ("2", "Guide", "all about reindexing"), ("3", None, None), ("4", "", "quick brown fox")], "id string, title string, body string")


def test_full_text(spark, docs):
    engine = Engine(spark, frames({"docs": docs}), Registry(DOC))
    assert ids(find(engine, DOC, search="reindex")) == ["1", "2"]
    assert ids(find(engine, DOC, search="guide -how")) == ["1", "2"]  # a stop word excludes nothing
    assert ids(find(engine, DOC, search='"brown fox"')) == ["4"] and ids(find(engine, DOC, search='"fox brown"')) == []
    assert ids(find(engine, DOC, search="the")) == []
    assert ids(find(engine, DOC, search="guide", candidates=["2"])) == ["2"]


def test_vector_and_guards(spark, tmp_path):
    entity = Entity("v", ("id",), (Searchable("body", Backend.VECTOR, dims=16),))
    table = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id long, body string")
    provider = HashEmbedding(16)
    engine = Engine(spark, frames({"v": table}), Registry(entity), Options(provider=provider), IndexStore(spark, str(tmp_path)))
    with pytest.raises(IndexNotReady, match="no active"):
        find(engine, entity, search="two")
    engine.reindex(entity)
    page = find(engine, entity, search="two")
    assert [r["id"] for r in page.items.collect()][0] == 2 and page.total == 2
    other = FunctionEmbedding(provider.embed, 16, "other")
    with pytest.raises(IndexNotReady, match="embedded by"):
        find(Engine(spark, engine.tables, engine.registry, Options(provider=other), engine.store), entity, search="two")
    with pytest.raises(IndexNotReady, match="dimensions"):
        find(Engine(spark, engine.tables, engine.registry, Options(provider=HashEmbedding(8)), engine.store), entity, search="two")
    with pytest.raises(QueryError, match="provider"):
        find(Engine(spark, engine.tables, engine.registry, Options(), engine.store), entity, search="two")


def test_coarse_vector_index(spark, tmp_path):
    entity = Entity("v", ("id",), (Searchable("body", Backend.VECTOR, dims=16),))
    table = spark.createDataFrame([(k, f"text {k}") for k in range(300)] + [(999, None)], "id long, body string")
    exact = Options(provider=HashEmbedding(16), vector_cells=8)
    engine = Engine(spark, frames({"v": table}), Registry(entity), exact, IndexStore(spark, str(tmp_path)))
    engine.reindex(entity)
    near = Engine(spark, engine.tables, engine.registry, Options(provider=HashEmbedding(16), vector_cells=8, probes=2), engine.store)
    got = find(near, entity, search="text 7", limit=10)
    assert got.items.first()["id"] == 7 and got.total < 300
    # queries are the rows with an id divisible by 100, against brute force; the number of cells was chosen when the index was measured
    sure = Engine(spark, engine.tables, engine.registry, Options(provider=HashEmbedding(16), vector_cells=8, least_recall=0.95), engine.store)
    shares = []
    for k in range(0, 300, 100):
        wanted = {r["id"] for r in find(engine, entity, search=f"text {k}", limit=10).items.collect()}
        shares.append(len(wanted & {r["id"] for r in find(sure, entity, search=f"text {k}", limit=10).items.collect()}) / 10)
    assert sum(shares) / len(shares) >= 0.9
    measured = engine.store.manifest(entity, "vector", "default").recall
    assert len(measured) == 8 and measured == sorted(measured) and measured[-1] == 1.0
    engine.refresh(entity, table.filter("id < 3"))
    assert find(engine, entity, search="text 7").total == 300


def test_zero_vectors_do_not_match(spark):
    entity = Entity("v", ("id",), (Searchable("e", Backend.VECTOR, dims=2),))
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0])], "id long, e array<float>")
    engine = Engine(spark, frames({"v": table}), Registry(entity), Options(provider=FunctionEmbedding(lambda t: [1.0, 0.0], 2, "m")))
    assert [r["id"] for r in find(engine, entity, search="x").items.collect()] == [1, 5]


def test_hybrid(spark):
    entity = Entity("h", ("key",), (Searchable("title", Backend.TRIGRAM), Searchable("body", Backend.FULL_TEXT)), filterable={"title": ANY})
    table = spark.createDataFrame([("both", "quantum", "quantum leap"), ("text", "other", "quantum"), ("tri", "quantum", "nothing")], "key string, title string, body string")
    engine = Engine(spark, frames({"h": table}), Registry(entity), Options(hybrid=HybridOptions()))
    assert [r["key"] for r in find(engine, entity, search="quantum").items.collect()][0] == "both"
    heavy = Entity("h", ("key",), (Searchable("title", Backend.TRIGRAM, weight=9.0), Searchable("body", Backend.FULL_TEXT)))
    assert [r["key"] for r in find(engine, heavy, search="quantum").items.collect()] == ["both", "tri", "text"]
    for extra in (dict(filters=(Filter("title", Op.EQ, "x"),)), dict(candidates=["a"])):
        with pytest.raises(QueryError, match="hybrid"):
            find(engine, entity, search="quantum", **extra)
    with pytest.raises(QueryError, match="several"):
        find(Engine(spark, engine.tables, engine.registry), entity, search="quantum")
    assert len(find(engine, entity, search="quantum", backend=Backend.FULL_TEXT).items.collect()) == 2


def test_search_cursor(spark):
    entity = Entity("r", ("id",), (Searchable("title", Backend.FULL_TEXT),))
    table = spark.createDataFrame([(f"{k:02d}", f"quarterly report number {k}") for k in range(12)], "id string, title string")
    engine = Engine(spark, frames({"r": table}), Registry(entity), Options(text=TextOptions()))
    seen, token = [], None
    while True:
        page = engine.search_cursor(entity, PagedQuery(Mode.CURSOR, 5, search="quarterly report", cursor=token))
        seen += ids(page)
        if not page.has_more:
            break
        token = page.next_cursor
    assert seen == [f"{k:02d}" for k in range(12)] and page.has_prev and page.next_cursor is None
    capped = Engine(spark, engine.tables, engine.registry, Options(hybrid=HybridOptions(most_cursor_offset=4)))
    assert not capped.search_cursor(entity, PagedQuery(Mode.CURSOR, 5, search="report")).has_more
    with pytest.raises(InvalidCursor):
        engine.search_cursor(entity, PagedQuery(Mode.CURSOR, 5, search="other", cursor=token))
    with pytest.raises(InvalidCursor, match="maximum"):
        capped.search_cursor(entity, PagedQuery(Mode.CURSOR, 5, search="quarterly report", cursor=token))


@pytest.fixture
def composed(spark, tmp_path):
    customer = Entity("customers", ("id",), (Searchable("name", Backend.FULL_TEXT),))
    line = Entity("lines", ("id",), (Searchable("sku", Backend.FULL_TEXT),))
    order = Entity("orders", ("id",), (Searchable("title", Backend.FULL_TEXT),), (Join("Customer", customer, foreign_key="customer_id"), Join("Lines", line, many=True, foreign_key="order_id")))
    tables = {
        "orders": spark.createDataFrame([("o1", "Gizmo box", "c1"), ("o2", "Plain", "c1")], "id string, title string, customer_id string"),
        "customers": spark.createDataFrame([("c1", "Aurora")], "id string, name string"),
        "lines": spark.createDataFrame([("l1", "o1", "alpha"), ("l2", "o1", "beta")], "id string, order_id string, sku string"),
    }
    engine = Engine(spark, lambda t: tables[t], Registry(order), store=IndexStore(spark, str(tmp_path / "index")))
    return engine, order, tables


def test_related_rows_refresh_their_owners(spark, composed):
    engine, order, tables = composed
    assert [c.action for c in plan_changes(engine.store, order)] == ["create"]
    engine.reindex(order)
    assert plan_changes(engine.store, order) == []
    assert ids(find(engine, order, search="aurora")) == ["o1", "o2"] and ids(find(engine, order, search="beta")) == ["o1"]

    before, tables["customers"] = tables["customers"], spark.createDataFrame([("c1", "Borealis")], "id string, name string")
    upkeep.refresh_changes(engine, order, "customers", upkeep.changed_rows(before, tables["customers"], ["id"]))
    assert ids(find(engine, order, search="borealis")) == ["o1", "o2"] and ids(find(engine, order, search="aurora")) == []
    assert ids(find(engine, order, search="gizmo alpha")) == ["o1"]

    # a line that moves is found through its old and its new owner
    before, tables["lines"] = tables["lines"], spark.createDataFrame([("l1", "o1", "alpha"), ("l2", "o2", "beta")], "id string, order_id string, sku string")
    upkeep.refresh_changes(engine, order, "lines", upkeep.changed_rows(before, tables["lines"], ["id"]))
    assert ids(find(engine, order, search="beta")) == ["o2"]

    before, tables["orders"] = tables["orders"], tables["orders"].filter("id = 'o1'")
    upkeep.refresh_changes(engine, order, "orders", upkeep.changed_rows(before, tables["orders"], ["id"]))
    assert engine.store.read(order, "fulltext", "default").count() == 1


def test_branches_do_not_multiply(composed):
    engine, order, _ = composed
    engine.reindex(order)
    tokens = engine.store.read(order, "fulltext", "default").filter("id = 'o1'").select(F.explode("default")).collect()
    assert sorted(t[0]["lexeme"] for t in tokens) == ["alpha", "aurora", "beta", "box", "gizmo"]
    assert [t[0]["pos"] for t in tokens] == [1, 2, 3, 4, 5]


def test_stream_refresh(spark, composed, tmp_path):
    engine, order, tables = composed
    engine.reindex(order)
    tables["customers"] = spark.createDataFrame([("c1", "Borealis")], "id string, name string")
    tables["customers"].write.parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema(tables["customers"].schema).parquet(str(tmp_path / "changes"))
    upkeep.watch(engine, order, "customers", stream, str(tmp_path / "checkpoint"), {"availableNow": True}).awaitTermination()
    assert ids(find(engine, order, search="borealis")) == ["o1", "o2"]


def test_jobs(spark, composed, tmp_path):
    engine, order, tables = composed
    queue = JobQueue(spark, str(tmp_path / "jobs.json"))
    assert upkeep.apply_mode(engine, queue, order, ReindexMode.DEFERRED) == 0
    assert upkeep.apply_mode(engine, queue, order, ReindexMode.CONCURRENT) == 1
    assert queue.enqueue("orders", "default") == 0  # one waits already
    assert upkeep.drain(engine, queue) == 1 and {j.status for j in queue.jobs()} == {"done"}
    before, tables["customers"] = tables["customers"], spark.createDataFrame([("c1", "Borealis")], "id string, name string")
    assert upkeep.enqueue_changes(engine, queue, order, "customers", upkeep.changed_rows(before, tables["customers"], ["id"])) == 2
    assert upkeep.work(engine, queue, rounds=1) == 2
    assert ids(find(engine, order, search="borealis")) == ["o1", "o2"]
    queue.enqueue("unknown", "default")
    assert upkeep.drain(engine, queue) == 0
    assert [(j.status, bool(j.error)) for j in queue.jobs() if j.entity == "unknown"] == [("failed", True)]
    assert [j.entity for j in queue.claimable()] == ["unknown"]
    queue.forget()
    assert len(queue.jobs()) == 1


def test_resumable(composed):
    engine, order, _ = composed
    engine.reindex(order)
    seen = []
    assert upkeep.resumable(engine, order, "default", 1, on_batch=seen.append) == 2 and seen == [("o1",), ("o2",)]
    assert upkeep.resumable(engine, order, "default", 5, after=("o1",)) == 1
    assert [r["id"] for r in upkeep.next_keys(engine, order, 5, ("o1",), inclusive=True).collect()] == ["o1", "o2"]


def test_cli(spark, composed, tmp_path, capsys, monkeypatch):
    engine, _, _ = composed
    queue = JobQueue(spark, str(tmp_path / "jobs.json"))
    monkeypatch.setattr(cli, "_load", lambda spec: (engine, queue))
    assert cli.main(["reindex", "--app", "x:y", "--entity", "orders"]) == 0 and "1 job(s) done" in capsys.readouterr().out
    assert cli.main(["reindex", "--app", "x:y", "--entity", "orders", "--start-after", "o1", "--batch-size", "7"]) == 0 and "default: 1 row(s)" in capsys.readouterr().out
    assert cli.main(["reindex", "--app", "x:y", "--entity", "nothing"]) == 1
    assert cli.main(["reindex", "--entity", "orders"]) == 2
    assert cli.main(["reindex-status", "--app", "x:y"]) == 0 and "done" in capsys.readouterr().out


def test_plans_push_filters_and_prune(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as stock", "'x' as wide", "'n' as name", "'s' as sku", "current_timestamp() as made").write.parquet(str(tmp_path / "widgets.parquet"))
    engine = Engine(spark, lambda t: spark.read.parquet(str(tmp_path / f"{t}.parquet")), Registry(WIDGET))
    rows = engine.ranked(Entity("widgets", ("id",), (Searchable("name"),), filterable={"stock": ANY}), PagedQuery(search="nnn", filters=(Filter("stock", Op.GT, "3"),))).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(stock,3)" in plan and "wide" not in plan
