"""Registered queries over the test tables, with SQL that gives the same rows.

Pages carry their order as a value (rank) and the total of the whole result, counted by an aggregate of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright import cursor
from pagewright.model import Backend, Entity, Filter, Join, Mode, OffsetPage, Op, PagedQuery, Parser, Registry, Searchable, Sort, Tables
from pagewright.operators import paging
from pagewright.operators.joins import owners_of
from pagewright.plans.engine import Engine, Options
from pagewright.plans.ranking import HybridOptions, Ranked, TextOptions
from pagewright.sources.embeddings import FunctionEmbedding, HashEmbedding, embedded
from pagewright.sources.index import IndexStore, composed_tokens
from pagewright.sources.jobs import collapse, enqueue_frame
from pagewright.sources.tables import parquet_folder, scratch
from pagewright.streaming.maintenance import batch_summary, next_keys, resumable

Query = Callable[[SparkSession, str], DataFrame]

ALL: frozenset[Op] = frozenset()
REGION = Entity("region", ("r_regionkey",), (Searchable("r_name"),))
NATION = Entity("nation", ("n_nationkey",), (Searchable("n_name"),), (Join("Region", REGION, foreign_key="n_regionkey"),))
PART = Entity(
    "part", ("p_partkey",), (Searchable("p_name"),),
    filterable={"p_brand": ALL, "p_size": ALL, "p_name": ALL, "p_type": ALL, "p_retailprice": ALL, "p_partkey": ALL},
    sortable=frozenset({"p_retailprice", "p_size", "p_name", "p_brand"}),
)
LINEITEM_OF_ORDER = Entity("lineitem", ("l_orderkey",), (), (Join("Part", PART, foreign_key="l_partkey"),))
ORDERS = Entity("orders", ("o_orderkey",), (), (Join("Lines", LINEITEM_OF_ORDER, many=True, foreign_key="l_orderkey"),))
CUSTOMER = Entity("customer", ("c_custkey",), (Searchable("c_mktsegment"),), (Join("Nation", NATION, foreign_key="c_nationkey"),), {"c_mktsegment": ALL, "c_acctbal": ALL}, frozenset({"c_acctbal", "c_mktsegment"}))
CUSTOMER_PARTS = Entity("customer", ("c_custkey",), (), (Join("Orders", ORDERS, many=True, foreign_key="o_custkey"),))
ORDER_STATUS = Entity("orders", ("o_orderkey",), (Searchable("o_orderpriority"),))
CUSTOMER_ORDERS = Entity("customer", ("c_custkey",), (), (Join("Orders", ORDER_STATUS, many=True, foreign_key="o_custkey", where="{c}.o_orderstatus = 'F'"),))
CONVERSATION = Entity("conversations", ("conv_id", "turn"), (Searchable("text", Backend.FULL_TEXT),), filterable={"role": ALL}, sortable=frozenset({"role"}))
EVENTS = Entity("events", ("event_id",), filterable={"event_type": ALL, "value": ALL, "ts": ALL, "user_id": ALL}, sortable=frozenset({"ts", "value", "event_type"}))
PAGES = Entity("pages", ("page_id",), filterable={"url": frozenset({Op.CONTAINS, Op.EQ})}, sortable=frozenset({"url"}))
DOCUMENT = Entity("documents", ("doc_id",), (Searchable("text", Backend.FULL_TEXT),), filterable={"lang": ALL, "source": ALL, "n_chars": ALL})
DOCUMENT_GROUPS = Entity("documents", ("doc_id",), (Searchable("text", Backend.FULL_TEXT, 1.0), Searchable("source", Backend.FULL_TEXT, 2.0, group="origin"), Searchable("lang", Backend.FULL_TEXT, 0.5, group="origin")))
DOCUMENT_WEIGHTED = Entity("documents", ("doc_id",), (Searchable("source", Backend.FULL_TEXT, 2.0), Searchable("text", Backend.FULL_TEXT, 0.5)))
EMBEDDED = Entity("embeddings", ("vec_id",), (Searchable("embedding", Backend.VECTOR, dims=64),), filterable={"label": ALL})
HYBRID = Entity("part", ("p_partkey",), (Searchable("p_name", Backend.TRIGRAM, 1.0), Searchable("p_type", Backend.FULL_TEXT, 2.0)))
HYBRID_STRICT = Entity("part", ("p_partkey",), (Searchable("p_name", Backend.TRIGRAM, 1.0, confidence=0.2), Searchable("p_type", Backend.FULL_TEXT, 1.0)))


def _engine(spark: SparkSession, sf: str, **options: object) -> Engine:
    return Engine(spark, parquet_folder(spark, sf), Registry(PART, CUSTOMER), Options(**options))


def _with_total(page: DataFrame, order: Sequence, whole: DataFrame) -> DataFrame:
    """A page with its order and the total: a count of its own, joined as one row. The window is over the page only."""
    total = whole.agg(F.count("*").alias("total_count"))
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).crossJoin(F.broadcast(total))


def browse(entity: Entity, columns: Sequence[str], filters: Sequence[Filter] = (), sort: Sequence[Sort] = (), limit: int = 10, page: int = 0) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        query = PagedQuery(limit=limit, page=page, filters=tuple(filters), sort=tuple(sort))
        items, rows = _engine(spark, sf)._page(entity, query, page * limit, limit)
        order = [paging.order_of(c, d) for c, d in paging.offset_order(entity, query.sort)]
        return _with_total(items, order, rows).select(*entity.key_columns, *columns, "rank", "total_count")

    return run


def browse_sql(table: str, key: str, columns: Sequence[str], where: str = "true", order: str = "", limit: int = 10, page: int = 0) -> str:
    by = ", ".join(x for x in (order, key) if x)
    listed = ", ".join(dict.fromkeys([*key.split(", "), *columns]))
    return f"select {listed}, rank, total_count from (select *, row_number() over (order by {by}) as rank, count(*) over () as total_count from {table} where {where}) where rank > {page * limit} and rank <= {(page + 1) * limit}".replace("rank, total", f"(rank - {page * limit})::bigint as rank, total", 1)


def filtered(entity: Entity, column: str, *filters: Filter) -> Query:
    """All rows that a filter leaves, as keys with one column."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        from pagewright.operators.predicates import apply_filters

        return apply_filters(_engine(spark, sf).tables(entity.table), entity, filters).select(*entity.key_columns, column)

    return run


def keyset(entity: Entity, columns: Sequence[str], sort: Sequence[Sort] = (), anchor: dict | None = None, backward: bool = False, filters: Sequence[Filter] = (), limit: int = 10) -> Query:
    """A keyset page from a row given by its values, through a token of its own."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _engine(spark, sf)
        query = PagedQuery(Mode.CURSOR, limit, sort=tuple(sort), filters=tuple(filters), backward=backward)
        order = paging.keyset_order(entity, query.sort)
        if anchor:
            query = query.with_(cursor=paging.anchor(anchor, order, entity.key_columns, engine._print(entity, query)))
        rows = engine.keyset_rows(entity, query, look_ahead=0)
        ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*[paging.order_of(c, d) for c, d in order])).cast("long"))
        return ranked.select(*dict.fromkeys([*entity.key_columns, *columns]), "rank")

    return run


def searched(entity: Entity, term: str, limit: int = 50, offset: int = 0, total: bool = True, **query: object) -> Query:
    """A search page: key, score to five places, rank, and the total."""
    options = {k: query.pop(k) for k in ("minimum_similarity", "text", "hybrid", "provider") if k in query}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _engine(spark, sf, **options)
        ranked = engine.ranked(entity, PagedQuery(search=term, **query), offset=offset, limit=limit)
        return _page_of(ranked, limit, offset, total)

    return run


def _page_of(ranked: Ranked, limit: int, offset: int, total: bool = True) -> DataFrame:
    rows = ranked.rows.withColumn("score", F.round("score", 5))
    ordered = rows.orderBy(*ranked.order)
    top = (ordered.offset(offset) if offset else ordered).limit(limit)
    if not total:
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*ranked.order)).cast("long"))
    return _with_total(top, ranked.order, rows)


def _knn(limit: int = 20, greatest: float | None = None, filters: Sequence[Filter] = ()) -> Query:
    """Neighbours of the vector of vec_id 0 among all vectors."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _engine(spark, sf)
        one = [float(x) for x in engine.tables("embeddings").filter("vec_id = 0").select("embedding").first()[0]]
        provider = FunctionEmbedding(lambda _: one, 64, "given")
        engine = _engine(spark, sf, provider=provider)
        rows = engine._restricted(EMBEDDED, PagedQuery(filters=tuple(filters)), engine.tables("embeddings"))
        return _page_of(engine._single(Backend.VECTOR, EMBEDDED, PagedQuery(search="x"), rows, greatest), limit, 0)

    return run


def _hash_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Texts embedded by the digest provider, nearest to a given text."""
    provider = HashEmbedding(16)
    entity = Entity("part", ("p_partkey",), (Searchable("p_name", Backend.VECTOR, dims=16),))
    return searched(entity, "anodized", 10, provider=provider)(spark, sf)


def _trigram_candidates(spark: SparkSession, sf: str) -> DataFrame:
    engine = _engine(spark, sf)
    ranked = engine.ranked(PART, PagedQuery(search=TERM, candidates=[*range(0, 400, 3), 3, 3]))
    return _page_of(ranked, 50, 0)


def _owner_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose indexed text changes with every part of size 7, a set that grows with the table."""
    engine = _engine(spark, sf)
    return owners_of(engine.tables, CUSTOMER_PARTS, CUSTOMER_PARTS.paths[0].hops, engine.tables("part").filter("p_size = 7"))


def _composed(spark: SparkSession, sf: str) -> DataFrame:
    """The composed text index of customers: own segment and the name of their nation, as counts and positions."""
    nation = Entity("nation", ("n_nationkey",), (Searchable("n_name", Backend.FULL_TEXT, 2.0),))
    entity = Entity("customer", ("c_custkey",), (Searchable("c_mktsegment", Backend.FULL_TEXT, 0.5),), (Join("Nation", nation, foreign_key="c_nationkey"),))
    engine = _engine(spark, sf)
    rows = composed_tokens(engine.tables, engine.tables("customer"), ["c_custkey"], entity.text_groups[0])
    return rows.select("c_custkey", F.array_join(F.transform("default", lambda t: F.concat_ws(":", t["lexeme"], t["pos"].cast("string"), t["label"])), " ").alias("tokens"))


def _reindex_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """An index of texts in which the rows of changed owners are replaced and others kept: lexeme counts by document."""
    engine = _engine(spark, sf)
    base = engine.tables("documents").select("doc_id", "text")
    new = base.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("replaced words here")).otherwise(F.col("text"))).filter("doc_id % 11 != 0")
    owners = new.filter("doc_id % 7 = 0").select("doc_id")
    old = composed_tokens(engine.tables, base, ["doc_id"], DOCUMENT.text_groups[0])
    fresh = composed_tokens(lambda _: new, new.join(owners, "doc_id", "left_semi"), ["doc_id"], DOCUMENT.text_groups[0])
    kept = old.join(owners, "doc_id", "left_anti").join(new.select("doc_id"), "doc_id", "left_semi")
    return kept.unionByName(fresh).select("doc_id", F.size("default").cast("long").alias("n_tokens"))


def _order_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A job for every order: its group by priority, its owner the customer."""
    orders = parquet_folder(spark, sf)("orders")
    return orders.select(F.col("o_orderkey").alias("id"), F.lit("customer").alias("entity"), F.col("o_orderpriority").alias("group_name"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("last_id"))


def _jobs_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return collapse(_order_jobs(spark, sf))


def _jobs_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as targeted jobs, but for those that wait already."""
    orders = parquet_folder(spark, sf)("orders")
    keys = orders.select(F.lit("orders").alias("entity"), F.lit("default").alias("group_name"), F.col("o_orderkey").cast("string").alias("last_id"))
    return enqueue_frame(keys.filter(orders["o_orderkey"] % 2 == 0), keys)


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    engine = _engine(spark, sf)
    return batch_summary(next_keys(engine, CONVERSATION, 100, (20, 1)), ["conv_id", "turn"])


def _composite_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Composite candidates: full-text search within given (conv_id, turn) pairs."""
    engine = _engine(spark, sf)
    pairs = [(k, t) for k in range(60) for t in (0, 1)]
    ranked = engine.ranked(CONVERSATION, PagedQuery(search="the", candidates=pairs))
    return _page_of(ranked, 50, 0)


TERM = "widget"


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != '')"


def similarity_sql(table: str, key: str, text: str, term: str, least: float = 0.35, where: str = "true") -> str:
    """(key, score) by the definition: the best stretch over all pairs of ends, on short texts."""
    words = _words_sql
    grams = "flatten(list_transform({w}, lambda w: list_transform(range(1, len(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])))"
    term_grams = f"list_distinct({grams.format(w=words(chr(39) + term + chr(39)))})"
    return f"""(select {key}, min(1 - sim) as score from (
      select {key}, (select max(len(list_intersect(a, list_distinct(g[i:j])))::double / len(list_distinct(list_concat(a, g[i:j])))) from range(1, len(g) + 1) s(i), range(1, len(g) + 1) e(j) where i <= j) as sim
      from (select {key}, {grams.format(w=words(text))} as g, {term_grams} as a from {table} where {where}))
      where sim >= {least} - 1e-12 group by {key})"""


def page_sql(source: str, key: str, descending: bool = False, limit: int = 50, offset: int = 0) -> str:
    direction = "desc" if descending else "asc"
    return f"select {key}, round(score::double, 5) as score, (rank - {offset})::bigint as rank, total_count from (select *, row_number() over (order by round(score::double, 5) {direction}, {key}) as rank, count(*) over () as total_count from {source}) where rank > {offset} and rank <= {offset + limit}"


def terms_sql(table: str, key: str, text: str, terms: Sequence[str], weight: float = 0.4, where: str = "true", need: str = "or") -> str:
    """(key, score) of single-term hits: weight times occurrences, all terms needed or any."""
    counts = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in terms]
    cond = f" {need} ".join(f"{c} > 0" for c in counts)
    return f"(select {key}, {weight} * ({' + '.join(counts)}) as score from (select *, {_words_sql(text)} as w from {table} where {where}) where {cond})"


SIM = similarity_sql("part", "p_partkey", "p_name", TERM)
KNN_SOURCE = "(select e.vec_id, 1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where {where})"
RRF = """(with t as (select p_partkey, row_number() over (order by score, p_partkey) as r from {tri} order by r limit {depth}),
 f as (select p_partkey, row_number() over (order by score desc, p_partkey) as r from {ft} order by r limit {depth})
 select p_partkey, sum(part) as score from (select p_partkey, {wt} * 1.0::double / (60 + r) as part from t union all select p_partkey, {wf} * 1.0::double / (60 + r) from f) group by p_partkey)"""


def _hybrid_sql(weights: tuple[float, float], label_weight: float, least: float = 0.35, limit: int = 20) -> str:
    tri, ft = similarity_sql("part", "p_partkey", "p_name", "small", least), terms_sql("part", "p_partkey", "p_type", ["small"], label_weight)
    return page_sql(RRF.format(tri=tri, ft=ft, depth=limit * 5, wt=weights[0], wf=weights[1]), "p_partkey", True, limit)


def _eq(field: str, value: str) -> Filter:
    return Filter(field, Op.EQ, value)


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


_first = dict(filters=[_eq("p_brand", "Brand#2"), Filter("p_size", Op.GTE, "10")], sort=[Sort("p_retailprice", True)])
_add("browse_offset", browse(PART, ["p_retailprice"], **_first), browse_sql("part", "p_partkey", ["p_retailprice"], "p_brand = 'Brand#2' and p_size >= 10", "p_retailprice desc nulls first"))
_add("browse_page_2", browse(PART, ["p_retailprice"], **_first, page=1), browse_sql("part", "p_partkey", ["p_retailprice"], "p_brand = 'Brand#2' and p_size >= 10", "p_retailprice desc nulls first", page=1))
_add("browse_past_end", browse(PART, ["p_retailprice"], **_first, page=900), browse_sql("part", "p_partkey", ["p_retailprice"], "p_brand = 'Brand#2' and p_size >= 10", "p_retailprice desc nulls first", page=900))
_add("browse_composite", browse(CONVERSATION, ["role"], sort=[Sort("role", True)], limit=25), browse_sql("conversations", "conv_id, turn", ["role"], order="role desc nulls first", limit=25))
_add("sort_multi_mixed", browse(PART, ["p_size", "p_retailprice"], sort=[Sort("p_size", True), Sort("p_retailprice")], limit=40), browse_sql("part", "p_partkey", ["p_size", "p_retailprice"], order="p_size desc nulls first, p_retailprice asc nulls last", limit=40))
_add("filter_and_sort", browse(EVENTS, ["event_type", "value"], [Filter("event_type", Op.NEQ, "click"), Filter("value", Op.GT, "50")], [Sort("ts")], 30), browse_sql("events", "event_id", ["event_type", "value"], "event_type <> 'click' and value > 50", "ts asc nulls last", 30))
for _op, _value, _where in ((Op.EQ, "10", "= 10"), (Op.NEQ, "10", "<> 10"), (Op.GT, "40", "> 40"), (Op.GTE, "40", ">= 40"), (Op.LT, "5", "< 5"), (Op.LTE, "5", "<= 5"), (Op.IN, "1, 2,,30 ", "in (1, 2, 30)"), (Op.IS_NULL, "", "is null"), (Op.NOT_NULL, "", "is not null")):
    _add(f"filter_{_op.value}", filtered(PART, "p_size", Filter("p_size", _op, _value)), f"select p_partkey, p_size from part where p_size {_where}")
_add("filter_contains", filtered(PART, "p_name", Filter("p_name", Op.CONTAINS, "RE")), "select p_partkey, p_name from part where contains(lower(p_name), 're')")
_add("filter_contains_literal", filtered(PAGES, "url", Filter("url", Op.CONTAINS, "?page=2&ref=")), "select page_id, url from pages where contains(lower(url), '?page=2&ref=')")
_add("filter_timestamp", filtered(EVENTS, "event_type", Filter("ts", Op.LT, "2024-01-02T00:00:00")), "select event_id, event_type from events where ts < timestamp '2024-01-02 00:00:00'")

_keys = ["p_size", "p_retailprice"]
_key_sql = "select p_partkey, p_size, p_retailprice, row_number() over (order by {order})::bigint as rank from (select * from part where {where} order by {read} limit 10)"
_up, _down = "p_size asc nulls last, p_partkey", "p_size desc nulls first, p_retailprice asc nulls last, p_partkey"
_back = "p_size desc nulls first, p_partkey desc"
_add("keyset_first", keyset(PART, _keys, [Sort("p_size")]), _key_sql.format(order=_up, where="true", read=_up))
_add("keyset_next_asc", keyset(PART, _keys, [Sort("p_size")], {"p_size": 5, "p_partkey": 100}), _key_sql.format(order=_up, where="p_size > 5 or p_size is null or (p_size = 5 and p_partkey > 100)", read=_up))
_add("keyset_next_desc", keyset(PART, _keys, [Sort("p_size", True), Sort("p_retailprice")], {"p_size": 40, "p_retailprice": 1000.0, "p_partkey": 5}), _key_sql.format(order=_down, where="p_size < 40 or (p_size = 40 and (p_retailprice > 1000 or p_retailprice is null or (p_retailprice = 1000 and p_partkey > 5)))", read=_down))
_add("keyset_prev", keyset(PART, _keys, [Sort("p_size")], {"p_size": 5, "p_partkey": 100}, backward=True), _key_sql.format(order=_up, where="p_size < 5 or (p_size = 5 and p_partkey < 100)", read=_back))
_add("keyset_composite", keyset(CONVERSATION, ["role"], anchor={"conv_id": 10, "turn": 1}, limit=25), "select conv_id, turn, role, row_number() over (order by conv_id, turn)::bigint as rank from (select * from conversations where conv_id > 10 or (conv_id = 10 and turn > 1) order by conv_id, turn limit 25)")

_add("trigram_direct", searched(PART, TERM), page_sql(SIM, "p_partkey"))
_add("trigram_page_2", searched(PART, TERM, 10, 10), page_sql(SIM, "p_partkey", limit=10, offset=10))
_add("trigram_typo", searched(PART, "wdget", minimum_similarity=0.4), page_sql(similarity_sql("part", "p_partkey", "p_name", "wdget", 0.4), "p_partkey"))
_two = Entity("part", ("p_partkey",), (Searchable("p_name"), Searchable("p_type")))
_brand = similarity_sql("part", "p_partkey", "p_type", TERM)
_add("trigram_multi_field", searched(_two, TERM), page_sql(f"(select p_partkey, min(score) as score from (select * from {SIM} union all select * from {_brand}) group by p_partkey)", "p_partkey"))
_add("trigram_with_filter", searched(PART, TERM, filters=(Filter("p_size", Op.LT, "20"),)), page_sql(similarity_sql("part", "p_partkey", "p_name", TERM, where="p_size < 20"), "p_partkey"))
_add("trigram_candidates", _trigram_candidates, page_sql(similarity_sql("part", "p_partkey", "p_name", TERM, where="p_partkey < 400 and p_partkey % 3 = 0"), "p_partkey"))
_add("trigram_search_fields", searched(_two, TERM, search_fields=("P_TYPE", "P_NAME")), ORACLE["trigram_multi_field"])
_add("trigram_unknown_field", searched(_two, TERM, search_fields=("nothing",)), "select 0::bigint as p_partkey, 0.0::double as score, 0::bigint as rank, 0::bigint as total_count where false")
_regions = similarity_sql("region", "r_regionkey", "r_name", "asia")
_nations = similarity_sql("nation", "n_nationkey", "n_name", "nation_1")
_add("trigram_join_n1", searched(Entity("customer", ("c_custkey",), (), (Join("Nation", Entity("nation", ("n_nationkey",), (Searchable("n_name"),)), foreign_key="c_nationkey"),)), "nation_1"), page_sql(f"(select c_custkey, score from customer join {_nations} on n_nationkey = c_nationkey)", "c_custkey"))
_add("trigram_join_depth2", searched(Entity("customer", ("c_custkey",), (), (Join("Nation", Entity("nation", ("n_nationkey",), (), (Join("Region", REGION, foreign_key="n_regionkey"),)), foreign_key="c_nationkey"),)), "asia"), page_sql(f"(select c_custkey, score from customer join nation on n_nationkey = c_nationkey join {_regions} on r_regionkey = n_regionkey)", "c_custkey"))
_prio = similarity_sql("(select distinct o_orderpriority from orders)", "o_orderpriority", "o_orderpriority", "urgent")
_add("trigram_join_1n", searched(Entity("customer", ("c_custkey",), (), (Join("Orders", ORDER_STATUS, many=True, foreign_key="o_custkey"),)), "urgent"), page_sql(f"(select o_custkey as c_custkey, min(score) as score from orders join {_prio} using (o_orderpriority) group by o_custkey)", "c_custkey"))
_add("trigram_hop_where", searched(CUSTOMER_ORDERS, "urgent"), page_sql(f"(select o_custkey as c_custkey, min(score) as score from orders join {_prio} using (o_orderpriority) where o_orderstatus = 'F' group by o_custkey)", "c_custkey"))
_distinct = similarity_sql("(select distinct p_name from part)", "p_name", "p_name", TERM)
_add("trigram_join_depth3", searched(CUSTOMER_PARTS, TERM), page_sql(f"(select o_custkey as c_custkey, min(score) as score from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey join {_distinct} using (p_name) group by o_custkey)", "c_custkey"))

_add("vector_knn", _knn(), page_sql(KNN_SOURCE.format(where="true"), "vec_id", limit=20))
_add("vector_knn_filtered", _knn(filters=[_eq("label", "1")]), page_sql(KNN_SOURCE.format(where="label = 1"), "vec_id", limit=20))
_add("vector_threshold", _knn(greatest=0.8), page_sql(f"(select * from {KNN_SOURCE.format(where='true')} where score <= 0.8)", "vec_id", limit=20))
_add("vector_hash_embedding", _hash_knn)

_doc = ("documents", "doc_id", "text")
_add("ft_single_term", searched(DOCUMENT, "the"), page_sql(terms_sql(*_doc, ["the"]), "doc_id", True))
_add("ft_or", searched(DOCUMENT, "the or und"), page_sql(terms_sql(*_doc, ["the", "und"]), "doc_id", True))
_not = f"(select doc_id, score from {terms_sql(*_doc, ['the'])} where doc_id not in (select doc_id from {terms_sql(*_doc, ['of'])}))"
_add("ft_not", searched(DOCUMENT, "the -of"), page_sql(_not, "doc_id", True))
_add("ft_with_filter", searched(DOCUMENT, "the", filters=(_eq("lang", "en"),)), page_sql(terms_sql(*_doc, ["the"], where="lang = 'en'"), "doc_id", True))
_add("ft_prefix", searched(DOCUMENT, "lic:*", text=TextOptions(Parser.RAW)), page_sql(f"(select doc_id, 0.4 * n as score from (select doc_id, len(list_filter({_words_sql('text')}, lambda x: starts_with(x, 'lic'))) as n from documents) where n > 0)", "doc_id", True))
_add("ft_composite_candidates", _composite_keys, page_sql(terms_sql("conversations", "conv_id, turn", "text", ["the"], where="conv_id < 60 and turn < 2"), "conv_id, turn", True))
_origin = "(select doc_id, case when source = 'src3' then 1.0 else 0 end + case when lang = 'src3' then 0.2 else 0 end as score from documents where source = 'src3' or lang = 'src3')"
_text3 = terms_sql(*_doc, ["src3"])
for _name, _sum, _how in (("ft_groups_max", False, "greatest(coalesce(a.score, 0), coalesce(b.score, 0))"), ("ft_groups_sum", True, "coalesce(a.score, 0) + coalesce(b.score, 0)")):
    _add(_name, searched(DOCUMENT_GROUPS, "src3", text=TextOptions(combine_by_sum=_sum)), page_sql(f"(select coalesce(a.doc_id, b.doc_id) as doc_id, {_how} as score from {_origin} a full join {_text3} b on a.doc_id = b.doc_id)", "doc_id", True))


def _matched(text: str, parser: Parser = Parser.WEBSEARCH, entity: Entity = DOCUMENT) -> Query:
    """All keys that match, without rank: what SQL can say about phrases and conjunctions."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _engine(spark, sf, text=TextOptions(parser))
        return engine.ranked(entity, PagedQuery(search=text)).rows.select(*entity.key_columns)

    return run


_spaced = f"(' ' || array_to_string({_words_sql('text')}, ' ') || ' ')"
_add("ft_and", _matched("the and of"), f"select doc_id from documents where contains({_spaced}, ' the ') and contains({_spaced}, ' and ') and contains({_spaced}, ' of ')")
_add("ft_phrase", _matched('"under the" license'), f"select doc_id from documents where contains({_spaced}, ' under the ') and contains({_spaced}, ' license ')")
_add("ft_phrase_parser", _matched("under the mit license", Parser.PHRASE), f"select doc_id from documents where contains({_spaced}, ' under the mit license ')")
_add("ft_plain", _matched("license -under", Parser.PLAIN), f"select doc_id from documents where contains({_spaced}, ' license ') and contains({_spaced}, ' under ')")
_add("ft_raw", _matched("(mit | gnu) & !apache", Parser.RAW), f"select doc_id from documents where (contains({_spaced}, ' mit ') or contains({_spaced}, ' gnu ')) and not contains({_spaced}, ' apache ')")
_both = f"""(select doc_id, sum(0.4 / (i - before)) as score from (
  select doc_id, i, w[i] as x, lag(i) over (partition by doc_id order by i) as before, lag(w[i]) over (partition by doc_id order by i) as y
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, {_words_sql('text')} as w from documents)) where w[i] in ('the', 'license'))
  where x <> y group by doc_id)"""
_add("ft_and_ranked", searched(DOCUMENT, "the license"), page_sql(_both, "doc_id", True))
_either = "(select doc_id, 1.0 * len(list_filter({s}, lambda x: x in ('src3', 'license'))) + 0.2 * len(list_filter({t}, lambda x: x in ('src3', 'license'))) as score from documents)".format(s=_words_sql("source"), t=_words_sql("text"))
_add("ft_weighted", searched(DOCUMENT_WEIGHTED, "src3 or license"), page_sql(f"(select * from {_either} where score > 0)", "doc_id", True))
_english = Entity("documents", ("doc_id",), (Searchable("text", Backend.FULL_TEXT, config="english"),))
_add("ft_english", searched(_english, "licensed versions"))

_plain = Entity("part", ("p_partkey",), (Searchable("p_name"), Searchable("p_type", Backend.FULL_TEXT, 1.0)))
_add("hybrid_rrf", searched(_plain, "small", 20, hybrid=HybridOptions()), _hybrid_sql((1.0, 1.0), 0.4))
_add("hybrid_weighted", searched(HYBRID, "small", 20, hybrid=HybridOptions()), _hybrid_sql((1.0, 2.0), 1.0))
_add("hybrid_threshold", searched(HYBRID_STRICT, "small", 20, hybrid=HybridOptions()), _hybrid_sql((1.0, 1.0), 0.4, 0.8))

_add("owner_resolution", _owner_resolution, "select distinct o_custkey as c_custkey from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_size = 7")
_composed_sql = "select c_custkey, array_to_string(list_concat(list_transform(a, lambda w, i: w || ':' || i || ':C'), list_transform(b, lambda w, i: w || ':' || (i + len(a)) || ':A')), ' ') as tokens from (select c_custkey, {a} as a, {b} as b from customer join nation on n_nationkey = c_nationkey)"
_add("index_composed_text", _composed, _composed_sql.format(a=_words_sql("c_mktsegment"), b=_words_sql("n_name")))
_add("reindex_incremental", _reindex_incremental, f"select doc_id, case when doc_id % 7 = 0 then 3 else len({_words_sql('text')}) end::bigint as n_tokens from documents where doc_id % 11 != 0")
_add("reindex_batch", _batch, "select count(*) as affected, max({'a': conv_id, 'b': turn}).a as last_conv_id, max({'a': conv_id, 'b': turn}).b as last_turn from (select * from conversations where conv_id > 20 or (conv_id = 20 and turn > 1) order by conv_id, turn limit 100)")
_job_sql = "select o_orderkey as id, 'customer' as entity, o_orderpriority as group_name, o_orderstatus as status, o_custkey::varchar as last_id from orders"
_add("jobs_collapse", _jobs_collapse, f"select * from ({_job_sql}) qualify row_number() over (partition by group_name, last_id order by id) = 1")
_add("jobs_enqueue", _jobs_enqueue, "select 'orders' as entity, 'default' as group_name, o_orderkey::varchar as last_id from orders where o_orderkey % 2 <> 0")


def embedded_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The digest embedding of each part's name, as a literal."""
    vectors = parquet_folder(spark, sf)("part").select("p_partkey", embedded(F.col("p_name"), HashEmbedding(8)).alias("v"))
    return vectors.select("p_partkey", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


_add("embed_hash", embedded_titles, "select p_partkey, 8::bigint as dims, 1.0::double as norm from part")


def cursor_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the rows of a page of nations, decoded again: keys and sort values survive the round trip."""
    rows = parquet_folder(spark, sf)("nation").orderBy("n_name", "n_nationkey").limit(25).collect()
    order = [("n_name", False), ("n_nationkey", False)]
    out = []
    for r in rows:
        token = cursor.decode(paging.anchor(r, order, ["n_nationkey"], "f" * 16))
        out.append((int(token.key_values[0]), token.sort_values[0]))
    return spark.createDataFrame(out, "n_nationkey int, n_name string")


_add("cursor_round_trip", cursor_tokens, "select n_nationkey, n_name from nation order by n_name, n_nationkey limit 25")


# --- pages through the engine, with and without an index store ----------------------------------------------------


def _paged(page: OffsetPage, columns: Sequence[str], order: Sequence) -> DataFrame:
    """The items of an offset page with their place, and what the page says of itself."""
    facts = {"total": page.total, "has_more": page.has_more, "has_prev": page.has_prev}
    ranked = page.items.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    score = [F.round("score", 5).alias("score")] if "score" in page.items.columns else []
    return ranked.select(*columns, *score, "rank", *[F.lit(v).alias(k) for k, v in facts.items()])


def _found(engine: Engine, entity: Entity, query: PagedQuery, columns: Sequence[str], best_high: bool) -> DataFrame:
    order = [F.col("score").desc() if best_high else F.col("score").asc(), *entity.key_columns]
    return _paged(engine.search_offset(entity, query), columns, order)


def _found_sql(source: str, table: str, key: str, columns: Sequence[str], descending: bool, limit: int, page: int = 0) -> str:
    listed, by = ", ".join(columns), "desc" if descending else "asc"
    low, high = page * limit, (page + 1) * limit
    return f"""select {listed}, round(score::double, 5) as score, (place - {low})::bigint as rank, total::int as total, total > {high} as has_more, {str(page > 0).lower()} as has_prev
      from (select *, row_number() over (order by score {by}, {key}) as place, count(*) over () as total from {source} join {table} using ({key})) where place > {low} and place <= {high}"""


def _stored(spark: SparkSession, tables: Tables, *entities: Entity, **options: object) -> Engine:
    return Engine(spark, tables, Registry(*entities), Options(**options), IndexStore(spark, scratch(spark)))


def _store_search(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a search over an index of all texts; full rows are fetched for the page only."""
    engine = _stored(spark, parquet_folder(spark, sf), DOCUMENT)
    engine.reindex(DOCUMENT)
    return _found(engine, DOCUMENT, PagedQuery(search="license", limit=10, page=1), ["doc_id", "lang", "n_chars"], True)


_add("store_search", _store_search, _found_sql(terms_sql("documents", "doc_id", "text", ["license"]), "documents", "doc_id", ["doc_id", "lang", "n_chars"], True, 10, 1))


def _store_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """All that an index holds of a word after texts of one source were replaced and those of a language deleted, by deltas."""
    tables = {"documents": parquet_folder(spark, sf)("documents").select("doc_id", "text", "lang", "source")}
    engine = _stored(spark, lambda name: tables[name], DOCUMENT)
    engine.reindex(DOCUMENT)
    old = tables["documents"]
    changed = old.withColumn("text", F.when(F.col("source") == "src3", F.concat(F.lit("license license of "), "lang")).otherwise(F.col("text")))
    tables["documents"] = changed.filter("lang is distinct from 'de'")
    engine.refresh(DOCUMENT, old.filter("source = 'src3'"))
    engine.refresh(DOCUMENT, old.filter("lang = 'de'"))
    return engine.ranked(DOCUMENT, PagedQuery(search="license")).rows.select("doc_id", F.round("score", 5).alias("score"))


_new_text = "case when source = 'src3' then 'license license of ' || lang else text end"
_add("store_refresh", _store_refresh, f"select doc_id, round(score::double, 5) as score from {terms_sql(f'(select doc_id, {_new_text} as text from documents where lang is distinct from {chr(39)}de{chr(39)})', 'doc_id', 'text', ['license'])}")


def _store_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A build that stops halfway and goes on from the key it reported: token counts of the index."""
    tables = parquet_folder(spark, sf)
    engine = _stored(spark, tables, CONVERSATION)
    size = -(-tables("conversations").count() // 6)
    seen: list[tuple] = []

    def stop(last: tuple) -> None:
        seen.append(last)
        if len(seen) == 3:
            raise InterruptedError

    try:
        resumable(engine, CONVERSATION, "default", size, on_batch=stop, fresh=True)
    except InterruptedError:
        resumable(engine, CONVERSATION, "default", size, seen[-1])
    index = engine.store.read(CONVERSATION, "fulltext", "default")
    return index.select("conv_id", "turn", F.size("default").cast("long").alias("n_tokens"))


_add("store_resumed", _store_resumed, f"select conv_id, turn, len({_words_sql('text')})::bigint as n_tokens from conversations where len({_words_sql('text')}) > 0")


def _store_trigram(spark: SparkSession, sf: str) -> DataFrame:
    engine = _stored(spark, parquet_folder(spark, sf), PART)
    engine.reindex(PART)
    return _found(engine, PART, PagedQuery(search=TERM, limit=20, filters=(Filter("p_size", Op.LT, "20"),)), ["p_partkey", "p_name"], False)


_add("store_trigram", _store_trigram, _found_sql(similarity_sql("part", "p_partkey", "p_name", TERM, where="p_size < 20"), "part", "p_partkey", ["p_partkey", "p_name"], False, 20))


def _store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What fits an entity to its indexes: nothing is there, then a group is renamed, one is new and one is gone."""
    tables = parquet_folder(spark, sf)
    first = Entity("nation", ("n_nationkey",), (Searchable("n_name", Backend.FULL_TEXT, group="names"), Searchable("n_name", Backend.TRIGRAM)))
    second = Entity("nation", ("n_nationkey",), (Searchable("n_name", Backend.FULL_TEXT, group="titles", previous_group="names"),))
    engine = _stored(spark, tables, first)
    done = [("1", c) for c in engine.apply_changes(first)] + [("2", c) for c in engine.apply_changes(second)] + [("3", c) for c in engine.apply_changes(second)]
    count = engine.ranked(second, PagedQuery(search="nation_1 or nation_2")).rows.count()
    return spark.createDataFrame([(n, c.action, c.kind, c.group, count) for n, c in done], "step string, action string, kind string, group_name string, found long")


_add("store_changes", _store_changes, "select * from (values ('1', 'create', 'fulltext', 'names'), ('1', 'create', 'trigram', 'default'), ('2', 'rename', 'fulltext', 'titles'), ('2', 'drop', 'trigram', 'default')) t(step, action, kind, group_name), "
     f"(select count(*) as found from nation where len(list_intersect({_words_sql('n_name')}, ['nation'])) > 0 and len(list_intersect({_words_sql('n_name')}, ['1', '2'])) > 0)")  # fmt: skip


def _cursor_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three pages forward, and from the last one back, by tokens: each page's rows and flags."""
    engine, out, token = _engine(spark, sf), [], None
    query = PagedQuery(Mode.CURSOR, 15, sort=(Sort("p_size", True),), filters=(_eq("p_brand", "Brand#2"),))
    for number in range(3):
        page = engine.search_cursor(PART, query.with_(cursor=token))
        out += [(number, k, r["p_partkey"], r["p_size"], page.has_more, page.has_prev) for k, r in enumerate(page.items)]
        token, back = page.next_cursor, page.prev_cursor
        if not page.has_more:
            break
    if page.has_prev:
        page = engine.search_cursor(PART, query.with_(cursor=back, backward=True))
        out += [(3, k, r["p_partkey"], r["p_size"], page.has_more, page.has_prev) for k, r in enumerate(page.items)]
    return spark.createDataFrame(out, "page int, place int, p_partkey long, p_size int, has_more boolean, has_prev boolean")


_add("cursor_walk", _cursor_walk, """with o as (select p_partkey, p_size, row_number() over (order by p_size desc nulls first, p_partkey desc) - 1 as k, count(*) over () as n, least(3, (count(*) over () + 14) // 15) as m from part where p_brand = 'Brand#2')
select (k // 15)::int as page, (k % 15)::int as place, p_partkey, p_size, n > (k // 15 + 1) * 15 as has_more, k >= 15 as has_prev from o where k < 45
union all select 3, (k % 15)::int, p_partkey, p_size, true, m > 2 from o where k // 15 = m - 2""")


def _search_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages of a search by tokens, full rows each."""
    engine, out, token = _engine(spark, sf), [], None
    for number in range(3):
        page = engine.search_cursor(PART, PagedQuery(Mode.CURSOR, 10, search=TERM, cursor=token))
        out += [(number, k, r["p_partkey"], r["p_name"], page.has_more, page.has_prev) for k, r in enumerate(page.items)]
        token = page.next_cursor
        if token is None:
            break
    return spark.createDataFrame(out, "page int, place int, p_partkey long, p_name string, has_more boolean, has_prev boolean")


_add("search_walk", _search_walk, f"""with o as (select p_partkey, p_name, row_number() over (order by score, p_partkey) - 1 as k, count(*) over () as n from {SIM} join part using (p_partkey))
select (k // 10)::int as page, (k % 10)::int as place, p_partkey, p_name, n >= (k // 10 + 1) * 10 as has_more, k >= 10 as has_prev from o where k < 30""")


def _filter_and_candidates(spark: SparkSession, sf: str) -> DataFrame:
    engine = _engine(spark, sf)
    ranked = engine.ranked(PART, PagedQuery(search=TERM, candidates=list(range(0, 400, 3)), filters=(Filter("p_size", Op.GTE, "20"),)))
    return _page_of(ranked, 50, 0)


_add("trigram_filter_and_candidates", _filter_and_candidates, page_sql(similarity_sql("part", "p_partkey", "p_name", TERM, where="p_partkey < 400 and p_partkey % 3 = 0 and p_size >= 20"), "p_partkey"))


def _nearest_to(spark: SparkSession, sf: str, key: int) -> FunctionEmbedding:
    one = [float(x) for x in parquet_folder(spark, sf)("embeddings").filter(F.col("vec_id") == key).select("embedding").first()[0]]
    return FunctionEmbedding(lambda _: one, 64, "given")


def _knn_candidates(spark: SparkSession, sf: str) -> DataFrame:
    engine = _engine(spark, sf, provider=_nearest_to(spark, sf, 0))
    return _page_of(engine.ranked(EMBEDDED, PagedQuery(search="x", candidates=list(range(0, 300, 2)))), 20, 0)


_add("vector_candidates", _knn_candidates, page_sql(KNN_SOURCE.format(where="e.vec_id < 300 and e.vec_id % 2 = 0"), "vec_id", limit=20))

KINDS = Entity("kinds", ("vec_id",), (Searchable("embedding", Backend.VECTOR, 1.0, dims=64), Searchable("kind", Backend.FULL_TEXT, 2.0)))


def _hybrid_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors and texts fused: neighbours of vector 0, and rows whose kind is that of label 1."""
    vectors = parquet_folder(spark, sf)("embeddings").withColumn("kind", F.concat(F.lit("kind"), F.col("label").cast("string")))
    engine = Engine(spark, lambda _: vectors, Registry(KINDS), Options(hybrid=HybridOptions(), provider=_nearest_to(spark, sf, 0)))
    return _page_of(engine.ranked(KINDS, PagedQuery(search="kind1"), limit=20), 20, 0)


_add("hybrid_vector", _hybrid_vector, page_sql(f"""(with v as (select vec_id, row_number() over (order by score, vec_id) as r from {KNN_SOURCE.format(where='true')} order by r limit 100),
 f as (select vec_id, row_number() over (order by vec_id) as r from embeddings where label = 1 order by r limit 100)
 select vec_id, sum(part) as score from (select vec_id, 1.0::double / (60 + r) as part from v union all select vec_id, 2.0::double / (60 + r) from f) group by vec_id)""", "vec_id", True, 20))

_sure = Entity("part", ("p_partkey",), (Searchable("p_name", Backend.TRIGRAM, 1.0), Searchable("p_type", Backend.FULL_TEXT, 1.0, confidence=0.5)))
_add("hybrid_text_threshold", searched(_sure, "small", 20, hybrid=HybridOptions()), page_sql(RRF.format(tri=similarity_sql("part", "p_partkey", "p_name", "small"), ft=f"(select * from {terms_sql('part', 'p_partkey', 'p_type', ['small'])} where score >= 0.5)", depth=100, wt=1.0, wf=1.0), "p_partkey", True, 20))
