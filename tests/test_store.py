"""The index store: segments, manifests, postings, the trigram index; the queue under two workers."""

import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from pagewright.functions import trigram
from pagewright.model import Backend, Entity, Filter, Join, Op, PagedQuery, Registry, Searchable
from pagewright.plans.engine import Engine, Options
from pagewright.plans.ranking import Ranked
from pagewright.sources import index as ix
from pagewright.sources import jobs as jobs_module
from pagewright.sources.embeddings import HashEmbedding, HttpEmbedding, embed_all
from pagewright.sources.index import Files, IndexStore, Numbered
from pagewright.sources.jobs import JobQueue
from pagewright.sources.tables import frames
from pagewright.streaming import maintenance as upkeep

DOC = Entity("docs", ("id",), (Searchable("body", Backend.FULL_TEXT),))
NAMED = Entity("names", ("id",), (Searchable("name"), Searchable("other")), filterable={"id": frozenset()})


def keys(df, key="id"):
    return sorted(r[key] for r in df.collect())


def search(engine, entity, term, **query):
    return keys(engine.search_offset(entity, PagedQuery(search=term, limit=100, **query)).items)


@pytest.fixture
def store(spark, tmp_path):
    tables = {"docs": spark.createDataFrame([(k, f"common word{k} {'even' if k % 2 == 0 else 'odd'}") for k in range(40)], "id long, body string")}
    engine = Engine(spark, lambda t: tables[t], Registry(DOC), store=IndexStore(spark, str(tmp_path / "index")))
    engine.reindex(DOC)
    return engine, tables


def change(spark, engine, tables, ids, text):
    """Give some documents another text, or delete them, and refresh these alone."""
    base = tables["docs"]
    listed = [int(k) for k in ids]
    tables["docs"] = base.filter(~F.col("id").isin(listed)) if text is None else base.withColumn("body", F.when(F.col("id").isin(listed), F.lit(text)).otherwise(F.col("body")))
    engine.refresh(DOC, spark.createDataFrame([(k,) for k in listed], "id long"))


def test_a_term_reads_its_own_files(store):
    engine, _ = store
    plan = engine.ranked(DOC, PagedQuery(search="word7")).rows._jdf.queryExecution().executedPlan().toString()
    assert "lex#" in plan and f"= {ix.lex_of('word7')})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(lexeme,word7)" in plan
    read = engine.store.rows(DOC, "fulltext", "default", lambda df: ix.of_terms(df, [ix.fulltext.Term("word7")])).select(F.input_file_name().alias("f"))
    assert [f"/lex={ix.lex_of('word7')}/" in r.f for r in read.collect()] == [True]


def test_queries_over_postings(store):
    engine, _ = store
    assert search(engine, DOC, "word7") == [7] and search(engine, DOC, "common even") == list(range(0, 40, 2))
    assert search(engine, DOC, "common -even") == list(range(1, 40, 2))
    assert search(engine, DOC, "-even") == list(range(1, 40, 2))  # nothing to look up: all keys, less those with the word
    assert search(engine, DOC, '"common word3"') == [3] and search(engine, DOC, "nothing") == []
    assert search(engine, DOC, "even or word3", candidates=[2, 3, 5]) == [2, 3]


def test_refresh_writes_its_owners_only(spark, store):
    engine, tables = store
    before = engine.store.manifest(DOC, "fulltext", "default")
    open_reader = engine.store.read(DOC, "fulltext", "default")
    change(spark, engine, tables, [7], "fresh text")
    now = engine.store.manifest(DOC, "fulltext", "default")
    assert now.segments[0] == before.segments[0] and now.version == before.version + 1
    assert [(s.rows, s.keys) for s in now.segments[1:]] == [(2, 1)]
    assert search(engine, DOC, "word7") == [] and search(engine, DOC, "fresh") == [7] and len(search(engine, DOC, "common")) == 39
    change(spark, engine, tables, [7, 8], None)
    assert search(engine, DOC, "fresh") == [] and search(engine, DOC, "word8") == []
    assert open_reader.count() == 40  # what a reader has begun to read is still there


def test_deltas_are_merged(spark, store, monkeypatch):
    engine, tables = store
    monkeypatch.setattr(ix, "MOST_DELTAS", 3)
    for k in range(7):
        change(spark, engine, tables, [k], f"round{k}")
        assert sum(1 for s in engine.store.manifest(DOC, "fulltext", "default").segments if s.keys) < 3
        assert search(engine, DOC, f"round{k}") == [k]
    assert len(search(engine, DOC, "common")) == 33 and search(engine, DOC, "round0 or round5") == [0, 5]
    change(spark, engine, tables, range(39), "all new now")
    change(spark, engine, tables, [39], None)
    engine.store.compact(DOC, "fulltext", "default")
    assert [s.keys for s in engine.store.manifest(DOC, "fulltext", "default").segments] == [0]  # merged with the base
    assert len(search(engine, DOC, "new")) == 39 and search(engine, DOC, "word39") == []


def test_segments_go_after_the_grace_time(spark, store):
    engine, tables = store
    old = engine.store.manifest(DOC, "fulltext", "default").segments[0].path
    engine.reindex(DOC)
    folder = engine.store._folder(DOC, "fulltext", "default")
    assert old in engine.store.files.names(folder)
    engine.store.grace = -1.0
    assert engine.store.sweep(DOC, "fulltext", "default") == 1 and old not in engine.store.files.names(folder)
    assert search(engine, DOC, "word7") == [7]


def test_a_build_keeps_later_deltas(spark, store, monkeypatch):
    engine, tables = store
    write = IndexStore._write

    def slow(self, entity, kind, group, rows, keys):
        segment = write(self, entity, kind, group, rows, keys)
        if keys is None:
            monkeypatch.setattr(IndexStore, "_write", write)
            change(spark, engine, tables, [3], "meanwhile")
        return segment

    monkeypatch.setattr(IndexStore, "_write", slow)
    engine.reindex(DOC)
    assert search(engine, DOC, "meanwhile") == [3] and search(engine, DOC, "word3") == []


def test_numbers_are_taken_once(spark, tmp_path):
    state = Numbered(Files(spark), str(tmp_path / "n"), keep=3)
    assert state.read() == (0, None)
    threads = [threading.Thread(target=lambda k=k: [state.update(lambda v, n: [*(v or []), k]) for _ in range(4)]) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, value = state.read()
    assert number == 12 and sorted(value) == sorted([0, 1, 2] * 4) and len(state.numbers()) == 3
    assert not state.files.create(f"{state.folder}/12.json", "[]") and json.loads(state.files.read(f"{state.folder}/12.json")) == value


def test_renamed_group(spark, tmp_path):
    table = spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, body string")
    old = Entity("docs", ("id",), (Searchable("body", Backend.FULL_TEXT, group="a"),))
    new = Entity("docs", ("id",), (Searchable("body", Backend.FULL_TEXT, group="b", previous_group="a"),))
    engine = Engine(spark, frames({"docs": table}), Registry(old), store=IndexStore(spark, str(tmp_path)))
    assert [c.action for c in engine.apply_changes(old)] == ["create"]
    base = engine.store.manifest(old, "fulltext", "a").segments
    assert [(c.action, c.previous) for c in engine.apply_changes(new)] == [("rename", "a")]
    assert engine.store.manifest(new, "fulltext", "b").segments == base and engine.store.groups(new, "fulltext") == ["b"]
    assert search(engine, new, "beta") == [2] and engine.apply_changes(new) == []
    gone = Entity("docs", ("id",), (Searchable("body"),))
    assert sorted((c.action, c.kind) for c in engine.apply_changes(gone)) == [("create", "trigram"), ("drop", "fulltext")]


# --- trigrams

MARKS = ["cafés", "café", "İstanbul", "straße", "STRASSE", "näive", "a_b", "x́y z", "１２", "ΣΑΣ", "Å", "ǆ word", "mixed-CASE text", ""]


def test_every_match_passes_the_prefilter(spark):
    texts = [f"{a} {b}" for a in MARKS for b in ("", "end", "ca fe")]
    terms = ["cafe", "café", "istanbul", "strasse", "straße", "naive", "a b", "xy", "word", "mixed", "σας"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (0.3, 0.6, 1.0):
        passed = {r.t: r for r in df.select("t", *[trigram.may_match(F.col("t"), x, least).alias(f"p{k}") for k, x in enumerate(terms)]).collect()}
        for k, term in enumerate(terms):
            for t in texts:
                assert passed[t][f"p{k}"] or trigram.word_similarity(term, t) < least


def test_trigram_column_is_trigrams(spark):
    df = spark.createDataFrame([(t,) for t in [*MARKS, None]], "t string")
    for r in df.select("t", trigram.trigram_column(F.col("t")).alias("g")).collect():
        assert set(r.g) == set(trigram.trigrams(r.t or "")) and len(r.g) == len(set(r.g))


def test_trigram_index(spark, tmp_path):
    rows = [(k, f"Zebra crossing {k}" if k % 5 else "Gadget", "umbrella" if k == 3 else None) for k in range(50)]
    tables = {"names": spark.createDataFrame(rows, "id long, name string, other string")}
    plain = Engine(spark, lambda t: tables[t], Registry(NAMED))
    engine = Engine(spark, plain.tables, plain.registry, store=IndexStore(spark, str(tmp_path)))
    assert search(engine, NAMED, "gadget") == list(range(0, 50, 5))  # without an index all rows are scanned
    assert engine.reindex(NAMED) == ["trigram:default"]
    for term in ("gadget", "crosing", "umbrela", "nothing at all"):
        assert search(engine, NAMED, term) == search(plain, NAMED, term)
    assert search(engine, NAMED, "gadget", filters=(Filter("id", Op.GT, "20"),)) == list(range(25, 50, 5))
    plan = engine.ranked(NAMED, PagedQuery(search="gadget")).rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [lex" in plan
    tables["names"] = tables["names"].withColumn("name", F.when(F.col("id") == 7, F.lit("zeppelin")).otherwise(F.col("name")))
    engine.refresh(NAMED, tables["names"].filter("id = 7"))
    assert search(engine, NAMED, "zeppelin") == [7]


def test_joined_texts_are_scored_where_they_stand(spark):
    part = Entity("parts", ("id",), (Searchable("name"),))
    line = Entity("lines", ("id",), (), (Join("Part", part, foreign_key="part_id"),))
    order = Entity("orders", ("id",), (), (Join("Lines", line, many=True, foreign_key="order_id"),))
    scored = spark.sparkContext.accumulator(0)
    tables = {
        "parts": spark.createDataFrame([(k, "needle" if k == 3 else f"hay{k}") for k in range(10)], "id long, name string"),
        "lines": spark.range(2000).selectExpr("id", "id % 100 as order_id", "id % 10 as part_id"),
        "orders": spark.range(100).toDF("id"),
    }
    engine = Engine(spark, lambda t: tables[t], Registry(order))
    ranked = engine.ranked(order, PagedQuery(search="needle"))
    assert keys(ranked.rows) == list(range(3, 100, 10)) and scored.value == 0
    plan = ranked.rows._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :]
    assert "name" in below and "order_id" not in below  # Python sees the leaf table alone


# --- hooks


def test_other_ranker_and_key_source(spark):
    table = spark.createDataFrame([(1, 9, "a"), (2, 8, "b")], "tenant long, nr long, name string")
    entity = Entity("t", searchables=(Searchable("name"),))
    registry = Registry(entity, key_source=lambda tables: {"t": ("tenant", "nr")} if "t" in tables else {})

    def by_number(engine, entity, query, rows, threshold):
        return Ranked(rows.select(*entity.key_columns, F.col("nr").cast("double").alias("score")), entity.key_columns, True)

    engine = Engine(spark, frames({"t": table}), registry, Options(rankers={Backend.TRIGRAM: by_number}, log_plans=True))
    assert registry["t"].key == ("tenant", "nr")
    page, rows = engine.fetch_offset(registry["t"], PagedQuery(search="whatever"))
    assert [r.nr for r in rows] == [9, 8] and page.total == 2


class Counting(HashEmbedding):
    def __init__(self, dims):
        super().__init__(dims)
        self.calls = []

    def embed_many(self, texts):
        self.calls.append(len(texts))
        return [self.embed(t) for t in texts]


def test_embedding_in_batches():
    provider = Counting(4)
    assert len(embed_all(provider, [f"t{k}" for k in range(300)])) == 300 and provider.calls == [128, 128, 44]


def test_http_embedding_tries_again():
    import http.server

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            seen.append(given)
            texts = [given] if isinstance(given, str) else given
            body = json.dumps({"data": [{"index": k, "embedding": [float(len(t)), 0.0]} for k, t in reversed(list(enumerate(texts)))]}).encode()
            self.send_response(503 if len(seen) == 1 else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = HttpEmbedding(f"http://127.0.0.1:{server.server_port}", "m", 2, pause=0.01)
        assert provider.embed_many(["a", "bbb"]) == [[1.0, 0.0], [3.0, 0.0]] and len(seen) == 2
        assert provider.embed("cc") == [2.0, 0.0]
    finally:
        server.shutdown()


# --- the queue


def test_two_workers_share_a_queue(spark, tmp_path):
    one, two = (JobQueue(spark, str(tmp_path / "jobs")) for _ in range(2))
    assert one.enqueue("docs", "default", ["1", "2", "2"]) == 2 and two.enqueue("docs", "default", ["2", "3"]) == 1
    assert two.enqueue("docs", "other") == 1
    mine = one.claim("docs", "default")
    assert [j.last_id for j in mine] == ["1", "2", "3"]
    assert two.enqueue("docs", "default", ["4"]) == 1
    assert two.claim("docs", "default") == [] and [j.group_name for j in two.claimable()] == ["other"]  # the group is held
    late = datetime.datetime.now(datetime.UTC) + jobs_module.STALE * 2
    assert len(two.claimable(late)) == 5  # a lease that ran out
    one.finish([j.id for j in mine])
    assert [j.last_id for j in two.claim("docs", "default")] == ["4"]
    assert one.frame().filter("status = 'done'").count() == 3


def test_stopped_build_goes_on(spark, store, tmp_path, caplog):
    engine, tables = store
    queue = JobQueue(spark, str(tmp_path / "jobs"))
    queue.enqueue("docs", "default", batch_size=10)
    refresh, calls = engine.refresh, []

    def failing(entity, owners, *rest):
        calls.append(sorted(r.id for r in owners.collect()))
        if len(calls) == 3:
            raise RuntimeError("storage is away")
        return refresh(entity, owners, *rest)

    engine.refresh = failing
    assert upkeep.drain(engine, queue) == 0 and "storage is away" in caplog.text
    (job,) = queue.jobs()
    assert job.status == "failed" and int(job.last_id) == max(calls[1])
    assert upkeep.drain(engine, queue) == 1
    assert sorted(k for c in calls[:2] + calls[3:] for k in c) == list(range(40)) and calls[3][0] == max(calls[1]) + 1
    assert len(search(engine, DOC, "common")) == 40


def test_worker_outlives_errors(spark, store, caplog):
    engine, _ = store

    class Away:
        def drain(self, run):
            raise OSError("no queue")

    assert upkeep.work(engine, Away(), rounds=2, sleep=lambda s: None) == 0 and caplog.text.count("no queue") >= 2
