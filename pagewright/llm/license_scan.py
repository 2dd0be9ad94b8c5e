"""License scans: phrase places, and an exact containment join of text blocks with license templates.

All of it is DataFrame functions. A template is the set of words of a public license or of a notice that points to
one; a block is a window of words of a text, running on over line ends, as notices are often wrapped. Templates of up
to L = 16, 32, 64, ... words are sought in windows of 2 L words at every L words, so each run of L words of a text lies
whole in one of them. A pair meets the threshold if the block holds at least need = ceil(threshold * size) of the
template's words. Words are ordered by how many texts of the whole corpus hold them, rarest first, and blocks meet
templates by an equi-join on the words of the templates' prefixes:

* prefix: a matching block holds one of the first size - need + 1 words of the template in that order;
* length: it holds at least need words of the vocabulary;
* position: where the first shared word stands p-th in the template and q-th among the block's words of the
  vocabulary, at most 1 + min(size - p - 1, held - q - 1) words can be shared.

Only pairs that pass are intersected in full. Texts are read twice, once for the order; a text without a word of any
prefix goes no further. What is broadcast is the templates' prefix words, up to a counted size; beyond, they are joined
by a shuffle. Nothing limits the number of templates or of their words.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import read_table, settle
from pagewright.llm.license_texts import NOTICES, TEXTS

#: What lies between words, once A-Z is folded.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Gap between a license's name and its version: up to nine words without a number.
_TO = r"(?: [^ 0-9]+){0,9} "
#: What the words of a block, joined by spaces, must show so that it is this license and no other of its family.
MARKS = {
    "agpl-3": f" gnu affero general public license{_TO}3 ",
    "apache-2": f" apache license{_TO}2 ",
    "cc-by": " creative commons attribution 4 0 ",
    "cc-by-nc": " (?:cc by nc|creative commons attribution noncommercial 4 0) ",
    "gpl-2": f" gnu general public license{_TO}2 ",
    "gpl-3": f" gnu general public license{_TO}3 ",
    "lgpl-2": f" gnu lesser general public license{_TO}2 1 ",
    "mit": " (?:mit license|copy of this software) ",
    "mpl-2": f" mozilla public license{_TO}2 0 ",
}
#: Share of a template's words that a block must hold; less where a mark tells the license.
THRESHOLD, MARKED_THRESHOLD = 0.92, 0.8
#: Words of the shortest windows are twice this.
SHORTEST = 16
#: Prefix words of templates up to this many are broadcast to the blocks, and results of this many texts to their rows.
MOST_BROADCAST = 50_000


@dataclass(frozen=True)
class Template:
    """Distinct words, how many of them a block must hold, the window class, and a mark (empty: none)."""

    label: str
    words: tuple[str, ...]
    need: int
    size: int
    mark: str

    @classmethod
    def of(cls, label: str, text: str, mark: str | None = None) -> Template:
        listed = [w for w in re.split(GAP, text.lower()) if w]
        mark = MARKS.get(label, "") if mark is None else mark
        size = SHORTEST
        while size < len(listed):
            size *= 2
        words = tuple(sorted(set(listed)))
        return cls(label, words, math.ceil((MARKED_THRESHOLD if mark else THRESHOLD) * len(words) - 1e-9), size, mark)


TEMPLATES = tuple(Template.of(label, text) for label, text in (*NOTICES, *TEXTS))


def _words(text: Column) -> Column:
    """Words with A-Z in lower case. Lower-casing other letters makes no letter of a-z but of the Kelvin sign, which is put aside."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("Å"))), GAP), "")


def _listed(words) -> Column:
    """A constant array of words, which is one literal of the plan whatever its length."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def vocabulary_order(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, tuple[int, str]]:
    """A sort key of each word of the templates: how many texts hold it, then the word."""
    words = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(_listed(words), _words(F.col("text").cast("string")))
    counts = {r["w"]: r["n"] for r in documents.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: (counts.get(w, 0), w) for w in words}


def _prefix(template: Template, order: dict[str, tuple[int, str]]) -> list[str]:
    """The rarest words of which a matching block holds one; those that no text holds cannot be met."""
    return [w for w in sorted(template.words, key=order.__getitem__)[: len(template.words) - template.need + 1] if order[w][0]]


def _places(phrase: str) -> Column:
    """Word numbers where a phrase begins; the words are looked through only if a text holds all of the phrase's."""
    first, *rest = phrase.split(" ")
    here = lambda x, i: reduce(lambda a, b: a & b, [x == first, *(F.get(F.col("_w"), i + k + 1) == w for k, w in enumerate(rest))])
    found = F.array_compact(F.transform("_w", lambda x, i: F.when(here(x, i), i)))
    every = sorted({first, *rest})
    return F.when(F.size(F.array_intersect(_listed(every), F.col("_held"))) == len(every), found).otherwise(F.array().cast("array<int>"))


def _block_starts(size: int, prefix: list[str]) -> Column:
    """(size, start) of the windows of a class that hold a prefix word of one of its templates."""
    at = F.array_compact(F.transform("_w", lambda x, i: F.when(x.isin(*prefix), F.floor(i / size).cast("int"))))
    near = F.transform(F.array(F.array_distinct(at)), lambda k: F.array_union(k, F.filter(F.transform(k, lambda i: i - 1), lambda i: i >= 0)))
    starts = F.transform(F.flatten(near), lambda k: F.struct(F.lit(size).alias("size"), (k * size).alias("start")))
    return F.when(F.arrays_overlap(F.col("_held"), _listed(prefix)), starts).otherwise(F.array().cast("array<struct<size:int,start:int>>"))


def _template_rows(spark: SparkSession, templates: tuple[Template, ...], order: dict[str, tuple[int, str]]) -> DataFrame:
    """One row for each prefix word of each template: (size, token, label, words in order, need, mark)."""
    rows = [(t.size, w, t.label, sorted(t.words, key=order.__getitem__), t.need, t.mark) for t in templates for w in _prefix(t, order)]
    frame = spark.createDataFrame(rows, "size int, token string, label string, words array<string>, need int, mark string")
    return F.broadcast(frame) if len(rows) <= MOST_BROADCAST else frame


def _matches(blocks: DataFrame, templates: tuple[Template, ...], order: dict[str, tuple[int, str]]) -> DataFrame:
    """(_key, start, label, containment) of the pairs that meet their threshold; blocks are (_key, _body, _starts)."""
    classes = sorted({t.size for t in templates})
    windows = blocks.select("_key", F.split("_body", " ").alias("_w"), F.explode("_starts").alias("_at")).select("_key", F.col("_at.size").alias("size"), F.col("_at.start").alias("start"), F.slice("_w", F.col("_at.start") + 1, 2 * F.col("_at.size")).alias("block"))
    known = lambda of: sorted({w for t in templates if t.size == of for w in t.words}, key=order.__getitem__)
    firsts = lambda of: sorted({w for t in templates if t.size == of for w in _prefix(t, order)}, key=order.__getitem__)
    by_class = lambda listed: F.coalesce(*[F.when(F.col("size") == c, F.array_intersect(_listed(listed(c)), F.col("block"))) for c in classes])
    tokens = windows.withColumn("held", by_class(known)).withColumn("token", F.explode(by_class(firsts)))
    pairs = tokens.join(_template_rows(blocks.sparkSession, templates, order), ["size", "token"]).filter(F.size("held") >= F.col("need"))
    shared = F.array_intersect("words", "held")
    p, q = F.array_position("words", F.col("token")), F.array_position("held", F.col("token"))
    room = 1 + F.least(F.size("words") - p, F.size("held") - q)
    pairs = pairs.filter(room >= F.col("need")).withColumn("_shared", shared).filter((F.size("_shared") >= F.col("need")) & (F.get("_shared", F.lit(0)) == F.col("token")))
    spaced = F.concat(F.lit(" "), F.array_join("block", " "), F.lit(" "))
    return pairs.filter((F.col("mark") == "") | F.rlike(spaced, F.col("mark"))).select("_key", "start", "label", (F.size("_shared") / F.size("words")).alias("containment"))


def license_scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """documents without text, plus n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    matches lists (start, label, containment) of every window that meets the threshold of a template and shows its
    mark, start being the number of the window's first word. score is the largest containment found, 1 where a base
    phrase stands, else 0. Null texts are empty: no words, no labels (empty strings), null places. Results depend on
    the text alone, so repeated rows get equal ones; a text of any length is cut into windows whole. Columns with
    these names are replaced, all others kept.
    """
    spark = documents.sparkSession
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kept = [c for c in documents.columns if c not in (*made, "text")]
    order = vocabulary_order(documents, templates)
    prefixes = {c: sorted({w for t in templates if t.size == c for w in _prefix(t, order)}) for c in sorted({t.size for t in templates})}
    telling = sorted({w for p in phrases for w in p.split(" ")} | {w for ws in prefixes.values() for w in ws})
    df = documents.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = df.select(*kept, "_text", _words(F.col("_text")).alias("_w"))
    df = df.withColumn("_held", F.array_intersect(_listed(telling), F.col("_w")))
    starts = [_block_starts(c, ws) for c, ws in prefixes.items() if ws]
    df = df.withColumns({f"_p{k}": _places(p) for k, p in enumerate(phrases)})
    df = df.withColumn("_starts", F.concat(*starts) if starts else F.array().cast("array<struct<size:int,start:int>>"))
    has = F.size("_starts") > 0
    number = [F.size(f"_p{k}") for k in range(len(phrases))]
    rows = settle(
        df.select(
            *kept,
            F.size("_w").cast("long").alias("n_words"),
            reduce(lambda a, b: a + b, number, F.lit(0)).cast("long").alias("n_base"),
            F.array_min(F.flatten(F.array(*[F.col(f"_p{k}") for k in range(len(phrases))]))).cast("long").alias("first_word"),
            F.array_max(F.flatten(F.array(*[F.col(f"_p{k}") for k in range(len(phrases))]))).cast("long").alias("last_word"),
            F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, label in zip(number, phrases.values(), strict=True)])).alias("_base"),
            F.when(has, F.sha2("_text", 256)).alias("_key"),
            F.when(has, F.array_join("_w", " ")).alias("_body"),
            F.when(has, F.col("_starts")).alias("_starts"),
        )
    )
    found = _matches(rows.filter("_key is not null").select("_key", "_body", "_starts"), templates, order)
    # copies of a text give equal matches, which are one before they are shuffled
    one = F.collect_set(F.struct("start", "label", "containment"))
    found = settle(found.groupBy("_key").agg(one.alias("matches"), F.max("containment").alias("_best")))
    few, many = found.agg(F.count("*"), F.sum(F.size("matches"))).first()
    found = F.broadcast(found) if few <= MOST_BROADCAST and (many or 0) <= 10 * MOST_BROADCAST else found
    joined = rows.filter("_key is not null").join(found, "_key", "left").withColumn("matches", F.coalesce(F.array_sort("matches"), F.array().cast("array<struct<start:int,label:string,containment:double>>")))
    others = rows.filter("_key is null").withColumns({"matches": F.array().cast("array<struct<start:int,label:string,containment:double>>"), "_best": F.lit(None).cast("double")})
    return joined.unionByName(others).select(
        *kept,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        "matches",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("matches")


def _oracle() -> str:
    """The same rows by brute force: every place of every phrase, every window against every template of its class."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split(' '))}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{t.label}', {quoted(t.words)}, {t.need}, {t.size}, '{t.mark}')" for t in TEMPLATES)
    return rf"""
with texts as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') as w from texts),
phrases(p, label) as (values {phrases}),
places as (select doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) as place from words, phrases),
templates(label, words, need, size, mark) as (values {templates}),
starts as (select doc_id, w, size, unnest(range(0, len(w), size)) as start from words, (select distinct size from templates)),
blocks as (select doc_id, size, w[start + 1:start + 2 * size] as b from starts),
found as (
  select doc_id, label, len(list_intersect(words, b)) / len(words) as containment from blocks join templates using (size)
  where len(list_intersect(words, b)) >= need and (mark = '' or regexp_matches(' ' || array_to_string(b, ' ') || ' ', mark))),
base as (select doc_id, count(*) as n, min(place) as lo, max(place) as hi, string_agg(distinct label, ',' order by label) as labels from places group by doc_id),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from places union all select doc_id, label from found) group by doc_id),
best as (select doc_id, max(containment) as score from found group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo::bigint as first_word, hi::bigint as last_word,
       coalesce(base.labels, '') as base_labels, coalesce(every.labels, '') as labels, case when n > 0 then 1.0 else coalesce(score, 0) end::double as score
from words w left join base on base.doc_id = w.doc_id left join every on every.doc_id = w.doc_id left join best on best.doc_id = w.doc_id
"""


ORACLE = _oracle()
