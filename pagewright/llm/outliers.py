"""Quality rules: fixed base rules, and robust multivariate outliers per language and source.

All of it is DataFrame functions. The statistics of a text are expressions of one row, rounded to fixed steps; equal
vectors of a group become one with a count, and the estimates see only these. Per (lang, source) the minimum (regularised)
covariance determinant is sought from several starts: the medians, and random elemental sets of four vectors. Each start
goes through concentration steps: the mean and covariance of the half of the rows that lies nearest by Mahalanobis
distance. After SHORT_STEPS the BEST starts with the least determinants go on, and the least determinant of all wins.
Its covariance gets the consistency factor of a half sample, rows beyond the REWEIGHT quantile are left out, and the
mean and covariance of the others, with the factor of that cut, give the distances that are judged.

A step is one aggregate over (group, start, bin of distances) with sums of integers, which agree from run to run, and
a running total over bins; one row a group and start is what goes on.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import read_table, settle

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = tuple("#*$%&|<>")
#: Words of a window whose repetition counts.
WINDOW = 8
#: Base rules: at least so many words; at most so many hundredths of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The transformed statistics, in steps of 1 / SCALE.
STATS = ("z_symbols", "z_lines", "z_word")
SCALE = 1000
#: Least standard deviation of each statistic: their squares are added to every covariance, so that groups of equal rows
#: do not reject what hardly differs and no determinant is zero. They are such that two symbols, one repeated line, or
#: words longer by their usual spread over LEAST_WORDS words do not by themselves reject the shortest text.
FLOORS = (0.4, 0.35, 0.15)
#: Random starts besides the medians, steps of all of them, and steps of the BEST ones after that.
STARTS, SHORT_STEPS, BEST, LONG_STEPS = 6, 2, 2, 4
#: Quantiles of the chi-square distribution of the squared distance: rows beyond the first do not count in the
#: reweighted estimate, rows beyond the second are rejected.
REWEIGHT, REJECT = 0.975, 0.9999
#: Groups times starts up to which estimates are broadcast; beyond, rows are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Histogram bins: BINS_PER_UNIT to each power of e of the squared distance.
BINS_PER_UNIT = 64


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for odd degrees of freedom."""
    total = math.erf(math.sqrt(x / 2))
    for k in range(1, degrees, 2):
        total -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return low


def consistency(share: float, degrees: int = len(STATS)) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to be that of all."""
    return share / chi_square(chi_square_quantile(share, degrees), degrees + 2)


#: Squared Mahalanobis distance beyond which a row is rejected.
CUTOFF = chi_square_quantile(REJECT, len(STATS))


def count_of(text: Column, char: str) -> Column:
    """How often an ASCII character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def text_statistics(documents: DataFrame) -> DataFrame:
    """documents without text, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the raw inputs of STATS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in documents.columns if c != "text"]
    df = documents.select(*kept, text.alias("_text"), words_of(text).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - WINDOW, F.lit(0)))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(F.size("_words") > WINDOW, windows))
    # Only texts with a repeated window go on: their windows are sorted with their places, and a window counts if a neighbour equals it.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    at = lambda i: F.get(F.col("_sorted"), i)
    twice = F.filter("_sorted", lambda x, k: (x["h"] == at(k + 1)["h"]) | ((k > 0) & (x["h"] == at(F.greatest(k - 1, F.lit(0)))["h"])))
    df = df.withColumn("_twice", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    raw = F.col("_text")
    white = reduce(lambda a, b: a + b, [count_of(raw, c) for c in WHITE_CHARS])
    return df.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        (F.length(raw) - white).cast("long").alias("word_chars"),
        reduce(lambda a, b: a + b, [count_of(raw, c) for c in SYMBOLS]).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def transformed(df: DataFrame) -> DataFrame:
    """STATS as integers: logarithms of smoothed rates, and of the mean length of words."""
    words, lines = F.col("n_words"), F.col("n_lines")
    step = lambda x: F.round(x * SCALE).cast("long")
    return df.withColumns(
        {
            "z_symbols": step(F.log1p(100.0 * F.col("n_symbols") / (words + 20))),
            "z_lines": step(F.log1p(20.0 * F.col("n_dup_lines") / (lines + 4))),
            "z_word": step(F.log((F.col("word_chars") + 5.0) / (words + 1))),
        }
    )


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_FIT = [*[f"m{i}" for i in range(3)], *[f"c{i}{j}" for i, j in _PAIRS]]


def _regular(factor: float = 1.0) -> list[list[Column]]:
    """The covariance of a fit times factor, plus FLOORS squared on the diagonal."""
    entry = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}") * factor + (FLOORS[i] ** 2 if i == j else 0.0)
    return [[entry(i, j) for j in range(3)] for i in range(3)]


def _determinant(cov: list[list[Column]]) -> Column:
    (a, b, c), (_, d, e), (_, _, f) = cov
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def _distance(cov: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance of STATS to the fit's mean, by the adjugate of the covariance."""
    (a, b, c), (_, d, e), (_, _, f) = cov
    inv = [[d * f - e * e, c * e - b * f, b * e - c * d], [None, a * f - c * c, b * c - a * e], [None, None, a * d - b * b]]
    diff = [F.col(s) / float(SCALE) - F.col(f"m{i}") for i, s in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(3):
        for j in range(i, 3):
            total = total + (1.0 if i == j else 2.0) * inv[i][j] * diff[i] * diff[j]
    return F.greatest(total / _determinant(cov), F.lit(0.0))


def _sums() -> list[Column]:
    """Exact sums of _n rows each: how many, of each statistic, of each product."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    return [
        F.sum("_n").alias("_rows"),
        *[wide(F.col("_n") * F.col(s)).alias(f"_s{i}") for i, s in enumerate(STATS)],
        *[wide(F.col("_n") * F.col(STATS[i]) * F.col(STATS[j])).alias(f"_q{i}{j}") for i, j in _PAIRS],
    ]


def _fit_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., _FIT) of rows of sums."""
    n = F.col("_rows").cast("double")
    mean = [F.col(f"_s{i}").cast("double") / n / SCALE for i in range(3)]
    cov = {(i, j): F.col(f"_q{i}{j}").cast("double") / n / SCALE**2 - mean[i] * mean[j] for i, j in _PAIRS}
    return sums.select(*keys, *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[cov[i, j].alias(f"c{i}{j}") for i, j in _PAIRS])


def _bounded(fits: DataFrame) -> DataFrame:
    """Fits to be joined: up to MOST_BROADCAST of them are broadcast, so hot groups stay where they are."""
    return F.broadcast(fits) if fits.count() <= MOST_BROADCAST else fits


def _step(vectors: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """The fits of the nearest half of each group: rows up to the bin of distances in which (n + 4) / 2 of them are reached."""
    bins = F.floor(F.log(F.greatest(_distance(_regular()), F.lit(1e-6))) * BINS_PER_UNIT).cast("int")
    counts = vectors.join(_bounded(fits), keys).groupBy(*keys, "start", bins.alias("_bin")).agg(*_sums())
    names = [c for c in counts.columns if c not in (*keys, "start", "_bin")]
    group = Window.partitionBy(*keys, "start")
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select(*keys, "start", "_bin", F.sum("_rows").over(group).alias("_all"), *[F.sum(c).over(upto).alias(c) for c in names])
    enough = F.least(F.col("_all"), F.floor((F.col("_all") + 4) / 2))
    first = running.filter(F.col("_rows") >= enough).groupBy(*keys, "start").agg(F.min_by(F.struct(*names), "_bin").alias("_at"))
    return settle(_fit_of(first.select(*keys, "start", "_at.*"), [*keys, "start"]))


def _median(vectors: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """The lower median of an integer column in each group, from counts of its values."""
    counts = vectors.groupBy(*keys, stat).agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys)
    places = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy(stat)), "_all": F.sum("_n").over(group)})
    return places.filter("2 * _upto >= _all").groupBy(*keys).agg(F.min(stat).alias(stat))


def _starts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Fits to start from: the medians (start 0), and sets of up to four vectors drawn by hash with probability by count."""
    medians = reduce(lambda x, y: x.join(y, keys), [_median(vectors, keys, s) for s in STATS])
    zero = medians.select(*keys, F.lit(0).alias("start"), *[(F.col(s) / float(SCALE)).alias(f"m{i}") for i, s in enumerate(STATS)], *[F.lit(0.0).alias(f"c{i}{j}") for i, j in _PAIRS])
    draws = []
    for k in range(1, STARTS + 1):
        dice = F.pmod(F.xxhash64(*STATS, F.lit(k)), F.lit(1 << 40))
        late = -F.log((F.floor(dice / 4) + 0.5) / float(1 << 38)) / F.col("_n")
        draws += [F.min_by("_packed", F.when(dice % 4 == part, late)).alias(f"_d{k}_{part}") for part in range(4)]
    packed = reduce(lambda a, b: a * 65536 + b, [F.least(F.greatest(F.col(s), F.lit(0)), F.lit(65535)) for s in STATS])
    drawn = vectors.withColumn("_packed", packed).groupBy(*keys).agg(*draws)
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.array_compact(F.array(*[F.col(f"_d{k}_{part}") for part in range(4)])).alias("of")) for k in range(1, STARTS + 1)]))
    each = drawn.select(*keys, sets.alias("x")).select(*keys, "x.start", F.explode("x.of").alias("_p"))
    rows = each.select(*keys, "start", F.lit(1).cast("long").alias("_n"), *[F.pmod(F.floor(F.col("_p") / 65536 ** (2 - i)), F.lit(65536)).alias(s) for i, s in enumerate(STATS)])
    return settle(zero.unionByName(_fit_of(rows.groupBy(*keys, "start").agg(*_sums()), [*keys, "start"])))


def minimum_determinants(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start, _FIT, determinant): the fit with the least determinant of each group of vectors (keys, STATS, _n)."""
    fits = _starts(vectors, keys)
    by_determinant = Window.partitionBy(*keys).orderBy("determinant", "start")
    for k in range(SHORT_STEPS + LONG_STEPS):
        if k == SHORT_STEPS:
            ranked = fits.withColumn("determinant", _determinant(_regular())).withColumn("_rank", F.row_number().over(by_determinant))
            fits = settle(ranked.filter(F.col("_rank") <= BEST).drop("_rank", "determinant"))
        fits = _step(vectors, fits, keys)
    last = fits.withColumn("determinant", _determinant(_regular())).withColumn("_rank", F.row_number().over(by_determinant))
    return last.filter("_rank = 1").drop("_rank")


def robust_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows plus distance: squared Mahalanobis distance to the reweighted estimate of the row's group. keys must not be null."""
    vectors = settle(rows.groupBy(*keys, *STATS).agg(F.count("*").alias("_n")))
    raw = settle(minimum_determinants(vectors, keys).drop("start", "determinant"))
    near = vectors.join(_bounded(raw), keys).filter(_distance(_regular(consistency(0.5))) <= chi_square_quantile(REWEIGHT, len(STATS)))
    fits = settle(_fit_of(near.groupBy(*keys).agg(*_sums()), keys))
    return rows.join(_bounded(fits), keys).withColumn("distance", _distance(_regular(consistency(REWEIGHT)))).drop(*_FIT)


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_rules(documents: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text, lang, source): its statistics, base_failed, distance and kept.

    Null texts are empty and fail the base rules. A null lang or source is a group of its own, apart from the
    empty string. Texts that fail the base rules are no part of the estimates. A group of equal rows, or of one,
    rejects nothing. Repeated rows count each, and rows with equal statistics tie; other columns are ignored.
    """
    df = documents.select("doc_id", F.col("text").cast("string").alias("text"), *[F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_{c}") for c in ("lang", "source")])
    rows = settle(transformed(text_statistics(df)).withColumn("base_failed", _base_failed()))
    keys = ["_lang", "_source"]
    passed = robust_distances(rows.filter(~F.col("base_failed")), keys).withColumn("kept", F.col("distance") <= CUTOFF)
    failed = rows.filter("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    return passed.unionByName(failed).drop(*keys, *STATS)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality_rules(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rules of all documents, which SQL can say too."""
    rows = text_statistics(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("n_lines")
    return rows.withColumn("base_failed", _base_failed())


#: The statistics by brute force: every window of every text.
STATISTICS_ORACLE = r"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
words as (select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x != '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts),
windows as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as h from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from words)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, h) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(8) r(k) group by doc_id),
counted as (
  select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from words w left join covered c on c.doc_id = w.doc_id)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted
"""
