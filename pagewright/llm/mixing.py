"""Mixing sources to target weights by weighted fair queueing.

Each source offers its documents in a shuffled order, and again from the start once it is through. A document's
virtual finish time is what its source has offered up to and with it, divided by the source's target, so all
sources reach their target at time 1. The mix is the global order by finish time, cut where the total budget is
used up.

Rows of equal doc_id, source and size are interchangeable, so they are one member of the queue with a count until the
end: a third of all rows may share one doc_id, or have none. Cumulative sums are taken in two levels, within hash
buckets and over bucket totals, with about sqrt(n) buckets of sqrt(n) members: no task holds a source, and bucket
totals are what crosses between tasks. The offers are then range-sorted by finish time over all partitions; partition
totals tell in which the budget ends, and only that one is summed row by row. One row per source is all that the targets
see, so sources are expected to be far fewer than documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import WORD, read_table, settle

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words, and no source more often than EPOCHS times.
SHARE, EPOCHS = 1.5, 2
SEED = "mix-1"
#: Targets of up to this many sources are broadcast to the documents.
MOST_BROADCAST = 50_000


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size): the budget by weight, capped, the excess shared again.

    Capped sources are those with the least cap for their weight. With the sources in that order, the level of the
    others is what is left of budget over weight left; it is right from the first source on that stays below it.
    The windows run over one row per source, not over documents.
    """
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") - 1) % len(weights))
    df = ranked.withColumn("_w", weight).withColumn("_cap", (epochs * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns(
        {
            "_budget": share * F.sum(F.col("source_size").cast("double")).over(every),
            "_weights": F.sum("_w").over(every),
            "_caps_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_weights_before": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    df = df.withColumn("_level", (F.col("_budget") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before")))
    df = df.withColumn("_level", F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(every))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return df.select("source", "n", "source_size", target.alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> Column:
    """df plus _upto: the sum of value over the rows of the same keys up to and with each, in the order of bucket, then order."""
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    return df.withColumn("_within", F.sum(value).over(within)).join(starts, [*keys, bucket]).withColumn("_upto", F.col("_start") + F.col("_within")).drop("_within", "_start")


def weighted_fair_queue(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of documents (doc_id, source, text): doc_id, source, copy, size, source_size, target, times, finish, taken.

    size is the number of words; finish the virtual finish time of the first round, and each later round adds
    source_size / target; times is how often the mix takes the document, taken its words in the mix. Null texts
    are empty; documents without words take no part (times 0) and have a null finish. A null source is a source of
    its own. Rows of equal doc_id, source and size are
    told apart by copy, counted from 1. The result depends on doc_id, source and size alone.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    members = settle(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    sources = members.groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = settle(source_targets(sources, weights, share, epochs)).withColumnRenamed("source", "_of")
    targets = F.broadcast(targets) if targets.count() <= MOST_BROADCAST else targets

    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    known = members.join(targets, F.col("source").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_key", key)
    offered = known.filter("size > 0").withColumn("_source", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))))
    spot = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    offered = offered.withColumn("_bucket", F.floor(spot * F.ceil(F.sqrt("n"))).cast("int")).withColumn("_words", F.col("size") * F.col("copies"))
    queued = _running(offered, ["_source"], "_bucket", ["_key", "doc_id", "size"], "_words")
    # copies of a member follow each other: the first starts where the members before it end
    queued = settle(queued.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("_upto") - F.col("_words")).alias("_start")))
    queued = _each(queued)
    queued = queued.withColumn("finish", (F.col("_start") + F.col("copy") * F.col("size")) / F.col("target")).withColumn("lap", F.col("source_size") / F.col("target")).drop("_start")

    last = _cut(queued, share, epochs)
    times = sum((F.when(F.col("finish") + k * F.col("lap") <= F.lit(last), 1).otherwise(0) for k in range(epochs)), F.lit(0))
    taken = queued.select("doc_id", "source", "copy", "size", "source_size", "target", times.cast("int").alias("times"), "finish", "lap")
    idle = _each(known.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", "copies"))
    idle = idle.select("doc_id", "source", "copy", "size", "source_size", "target", F.lit(0).alias("times"), F.lit(None).cast("double").alias("finish"), F.lit(None).cast("double").alias("lap"))
    return taken.unionByName(idle).withColumn("taken", F.col("size") * F.col("times"))


def _each(members: DataFrame, most: int = 64) -> DataFrame:
    """A row for each copy, numbered from 1 in copy; more than most copies are dealt to all tasks in parts of that size."""
    one = members.filter(F.col("copies") <= most).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    parts = members.filter(F.col("copies") > most).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(most).cast("long")))).repartition("_part", "size", "source")
    many = parts.withColumn("copy", F.explode(F.sequence(F.col("_part") + 1, F.least(F.col("copies"), F.col("_part") + most)))).drop("_part")
    return one.unionByName(many).drop("copies")


def _cut(queued: DataFrame, share: float, epochs: int) -> float:
    """The last finish time at which all that has finished fits the budget; infinite if everything fits."""
    laps = F.explode(F.array(*[F.struct((F.col("finish") + k * F.col("lap")).alias("finish"), F.col("size")) for k in range(epochs)]))
    offers = queued.select(laps.alias("x")).select("x.*")
    # equal finish times share a partition, so the cut is the same wherever the ranges are cut
    placed = settle(offers.repartitionByRange("finish").withColumn("part", F.spark_partition_id()))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("part").agg(F.sum("size").alias("words"), F.max("finish").alias("last")).withColumn("upto", F.sum("words").over(upto))
    whole = totals.agg(F.sum("words")).first()[0]
    if not whole:
        return float("inf")
    budget = min(share, epochs) * float(whole) / epochs
    over = totals.filter(F.col("upto") > budget).orderBy("part").first()
    if over is None:
        return float("inf")
    before = totals.filter(F.col("part") < over["part"]).agg(F.max("last")).first()[0]
    inside = placed.filter(F.col("part") == over["part"]).withColumn("reached", F.sum("size").over(Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)) + F.lit(over["upto"] - over["words"]))
    last = inside.filter(F.col("reached") <= budget).agg(F.max("finish")).first()[0]
    return next((float(x) for x in (last, before) if x is not None), -1.0)


def mixed_documents(documents: DataFrame, ordered: bool = True, **mix: object) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    ordered sorts them by virtual finish time over all partitions. Rows of equal doc_id, source and number of words are
    numbered within their input partition, and partitions by running counts, so a doc_id that many rows share (or
    lack) stays spread. Documents without words are not in the mix; columns with clashing names are kept as they are.
    """
    queue = weighted_fair_queue(documents, **mix)
    shares = queue.filter("times > 0").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_src"), F.col("size").alias("_words"), F.col("copy").alias("_copy"), F.col("times").alias("_times"), F.col("finish").alias("_begin"), F.col("lap").alias("_lap"))
    laps = F.explode(F.transform(F.sequence(F.lit(0), F.col("_times") - 1), lambda k: F.col("_begin") + k * F.col("_lap")))
    if queue.groupBy("doc_id").count().filter("count > 1").isEmpty():
        joined = documents.join(shares, F.col("doc_id").eqNullSafe(F.col("_doc")))
    else:
        size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
        key = ["_doc", "_src", "_words"]
        left = documents.withColumns({"_doc": F.col("doc_id"), "_src": F.col("source").cast("string"), "_words": size, "_part": F.spark_partition_id()}).filter("_words > 0")
        counts = left.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(*[F.col(c).alias(f"_of{c}") for c in (*key, "_part")], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        left = left.withColumn("_row", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.xxhash64("text"))))
        here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in (*key, "_part")])
        numbered = left.join(starts, here).withColumn("_at", F.col("_before") + F.col("_row")).select(*documents.columns, *[F.col(c).alias(f"_own{c}") for c in key], "_at")
        there = reduce(lambda a, b: a & b, [F.col(f"_own{c}").eqNullSafe(F.col(c)) for c in key])
        joined = numbered.join(shares, there & (F.col("_at") == F.col("_copy")))
    out = joined.select(*documents.columns, laps.alias("_finish"))
    if ordered:
        out = out.repartitionByRange("_finish").sortWithinPartitions("_finish", "doc_id")
    return out.drop("_finish")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = weighted_fair_queue(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return queue.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with rows as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size from rows group by source),
ranked as (select *, row_number() over (order by source asc nulls last) as k from sources),
weighted as (select *, [5.0, 2.0, 1.0][(k - 1) % 3 + 1]::double as w, 2.0::double * source_size as cap from ranked),
summed as (
  select *, 1.5::double * sum(source_size) over () as budget, sum(w) over () as weights,
         coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) as caps_before,
         coalesce(sum(w) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) as weights_before
  from weighted),
levels as (select *, (budget - caps_before) / (weights - weights_before) as own from summed),
level as (select max(own) as level from levels where cap / w >= own),
targets as (select source, source_size, coalesce(least(cap, level * w), cap) as target from levels, level),
queued as (
  select doc_id, r.source, size, source_size, target,
         sum(size) over (partition by r.source order by md5(coalesce(doc_id::varchar, '') || 'mix-1'), doc_id, size rows between unbounded preceding and current row) as upto
  from rows r join targets t on r.source is not distinct from t.source),
timed as (select *, upto / target as finish, source_size / target as lap from queued where size > 0),
offers as (select finish as t, size from timed union all select finish + lap, size from timed),
sums as (select t, sum(sum(size)) over (order by t) as reached from offers group by t),
cut as (select coalesce(max(t), -1) as last from sums where reached <= (select 1.5::double * sum(size) from rows))
select doc_id, size, source_size, target,
       (size * ((finish <= last)::int + (finish + lap <= last)::int))::bigint as taken from timed, cut
union all select doc_id, size, source_size, target, 0 from queued where size = 0
"""
