"""Toxicity by a classifier chain: linear models over hashed words and word beginnings.

The categories are predicted in order. Each model sees the text's features and the probabilities of the
categories before it; in training these come from models that did not see the row (out-of-fold), so that later
links learn how far earlier ones can be trusted. The last category is toxicity as such. The categories before it
are toxicity in each language of the labelled rows, as these have insults of their own; a score never reads the
language, only the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import is_held_out, labelled_sample, mix, passes, read_table, span_hashes, texts_of, with_fields, word_bounds

#: Bound on the labelled rows that are learned from.
MOST_LABELLED = 8_000
#: Hash space of features, and how many of them a model may use, the most telling first (a parameter of the model's size).
SPACE, MOST_FEATURES = 1 << 20, 4096
#: Beginnings of words, in bytes, that are features besides the whole word.
BEGINNINGS = (4, 5, 6)
#: A feature must be in so many texts of the category, and so many times as frequent there as elsewhere.
LEAST_TEXTS, LEAST_LIFT = 4, 4.0
FOLDS, STEPS, RATE, RIDGE = 5, 150, 0.5, 1e-4
#: A language is a category of its own from so many toxic labelled rows on; all rows count in the last category.
LEAST_OF_LANGUAGE = 5
#: Toxic from this probability on.
ACCEPT = 0.3

_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and beginning, with repeats."""
    rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in passes(offsets):
        part, at = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        starts, ends, first = word_bounds(part, at, _GAP)
        of_row = np.repeat(np.arange(begin, end), np.diff(first))
        for kind, most in enumerate((None, *BEGINNINGS)):
            use = slice(None) if most is None else np.flatnonzero(ends - starts >= most)
            stop = ends if most is None else starts[use] + most
            rows.append(of_row[use])
            features.append((mix(span_hashes(part, starts[use], stop) + np.uint64(kind)) % np.uint64(SPACE)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


def _places(picked: np.ndarray) -> np.ndarray:
    """The place of each feature among the picked ones, -1 for the others."""
    out = np.full(SPACE, -1, np.int32)
    out[picked] = np.arange(len(picked), dtype=np.int32)
    return out


@dataclass
class Linear:
    """Logistic model over some hashed features and the probabilities of earlier links."""

    picked: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray
    bias: float

    def score(self, row: np.ndarray, feature: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Probabilities of len(before) rows; (row, feature) pairs must be distinct."""
        at = _places(self.picked)[feature]
        hit = at >= 0
        total = np.bincount(row[hit], self.weight[at[hit]], len(before)) + before @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _lift(yes: np.ndarray, every: np.ndarray, positive: float, n: int) -> np.ndarray:
    """How many times as frequent each feature is in the positive texts as in the others."""
    return (yes / positive) / ((every - yes + 0.5) / (n - positive + 0.5))


def fit_linear(row: np.ndarray, feature: np.ndarray, before: np.ndarray, y: np.ndarray, use: np.ndarray) -> Linear:
    """Fit on the rows of use: features are chosen by lift among them, weights by full-batch gradient steps with momentum."""
    n, positive = int(use.sum()), float(y[use].sum())
    nothing = Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), -4.0 if positive == 0 else 4.0)
    if positive == 0 or positive == n:
        return nothing
    inside = use[row]
    r, f = row[inside], feature[inside]
    yes, every = np.bincount(f[(y > 0)[r]], minlength=SPACE), np.bincount(f, minlength=SPACE)
    lift = _lift(yes, every, positive, n)
    able = np.flatnonzero((yes >= LEAST_TEXTS) & (lift >= LEAST_LIFT))
    picked = np.sort(able[np.argsort(-yes[able] * np.log(lift[able]), kind="stable")[:MOST_FEATURES]])
    at = _places(picked)[f]
    hit = at >= 0
    place = np.full(len(use), -1)
    place[use] = np.arange(n)
    r, at = place[r[hit]], at[hit]
    target, known = y[use], before[use]
    weight, earlier, bias = np.zeros(len(picked)), np.zeros(before.shape[1]), float(np.log(positive / (n - positive)))
    pull = [np.zeros_like(weight), np.zeros_like(earlier), 0.0]
    per_word = np.maximum(np.bincount(at, minlength=len(picked)), 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, weight[at], n) + known @ earlier + bias, -30, 30)))
        gap = target - p
        steps = [np.bincount(at, gap[r], len(picked)) / per_word - RIDGE * weight, known.T @ gap / n - RIDGE * earlier, gap.mean()]
        pull = [0.8 * a + RATE * b for a, b in zip(pull, steps, strict=True)]
        weight, earlier, bias = weight + pull[0], earlier + pull[1], bias + float(pull[2])
    return Linear(picked, weight, earlier, bias)


@dataclass
class Chain:
    names: list[str]
    links: list[Linear]

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """A column of probabilities for each category; repeated features of a row count once."""
        known = np.unique(np.concatenate([x.picked for x in self.links])) if self.links else np.zeros(0, np.int64)
        able = np.zeros(SPACE, bool)
        able[known] = True
        keep = able[feature]
        pair = np.unique(row[keep] * SPACE + feature[keep])
        row, feature = pair // SPACE, pair % SPACE
        out = np.zeros((rows, 0))
        for link in self.links:
            out = np.column_stack([out, link.score(row, feature, out)])
        return out


def fit_chain(row: np.ndarray, feature: np.ndarray, targets: dict[str, np.ndarray], ids: np.ndarray) -> Chain:
    """Links in the order of targets; folds go by id. (row, feature) pairs must be distinct."""
    rows, fold = len(ids), ids % FOLDS
    before, links = np.zeros((rows, 0)), []
    for y in targets.values():
        out = np.zeros(rows)
        for k in range(FOLDS):
            part = fold == k
            if part.any():
                out[part] = fit_linear(row, feature, before, y, ~part).score(row, feature, before)[part]
        links.append(fit_linear(row, feature, before, y, np.ones(rows, bool)))
        before = np.column_stack([before, out])
    return Chain(list(targets), links)


def train(documents: DataFrame, labels: DataFrame, bound: int = MOST_LABELLED) -> Chain:
    """Learn from about bound labelled rows, none of them held out; their hashed features reach the driver.

    Rows without doc_id have no label and are not learned from; a repeated doc_id counts once a row, and a doc_id
    labelled twice takes the larger label. A text of any length brings each feature once.
    """

    def gather(batches):
        for batch in batches:
            row, feature = text_features(*texts_of(batch.column("text")))
            pair = np.unique(row * SPACE + feature)
            at = np.searchsorted(pair, np.arange(batch.num_rows + 1) * SPACE)
            sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((pair % SPACE).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("lang"), sets], ["doc_id", "toxic", "lang", "x"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = labelled_sample(texts, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), ["toxic"], bound, 7)
    rows = sample.select("doc_id", "toxic", "lang", "text").mapInArrow(gather, "doc_id long, toxic int, lang string, x array<int>").toArrow().sort_by("doc_id").combine_chunks()
    y = (rows["toxic"].to_numpy() > 0).astype(float)
    lang = np.array([x or "" for x in rows["lang"].to_pylist()], object)
    names, counts = np.unique(lang[y > 0].astype(str), return_counts=True)
    languages = [names[k] for k in np.argsort(-counts, kind="stable") if counts[k] >= LEAST_OF_LANGUAGE]
    targets = {f"toxic_{x}": y * (lang == x) for x in languages} | {"toxic": y}
    ids = rows["doc_id"].to_numpy()
    row, feature = features_in_reach(rows["x"], targets, ids)
    return fit_chain(row, feature, targets, ids)


def features_in_reach(sets: pa.ChunkedArray, targets: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the features that some link can pick: counted for each category, with each fold left out and with none."""
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in sets.chunks)]).astype(np.int64))
    feature = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy(zero_copy_only=False) for c in sets.chunks)]).astype(np.int32)
    fold = ids % FOLDS
    counted = lambda rows: np.bincount(feature[rows[row]], minlength=SPACE).astype(np.int32)
    every = [counted(fold == k) for k in range(FOLDS)]
    able = np.zeros(SPACE, bool)
    for y in targets.values():
        yes = [counted((fold == k) & (y > 0)) for k in range(FOLDS)]
        for left_out in range(FOLDS + 1):
            use = fold != left_out
            n, positive = int(use.sum()), float(y[use].sum())
            if 0 < positive < n:
                here, there = (sum(x[k] for k in range(FOLDS) if k != left_out) for x in (yes, every))
                able |= (here >= LEAST_TEXTS) & (_lift(here, there, positive, n) >= LEAST_LIFT)
    keep = able[feature]
    return row[keep], feature[keep]


def score_toxicity(documents: DataFrame, model: Chain) -> DataFrame:
    """documents plus categories (map of the chain's probabilities), score (the last one) and toxic (from ACCEPT on).

    Whole texts in one pass without a shuffle. Null and empty texts have no features. Rows are scored one by one, so
    null or repeated doc_ids change nothing, and equal texts tie. Columns of those names are replaced, all others kept.
    """
    df = documents.drop("categories", "score", "toxic")
    names = df.columns

    def score(batches):
        for batch in batches:
            p = model.score(*text_features(*texts_of(batch.column(names.index("text")))), batch.num_rows)
            kinds = pa.MapArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * p.shape[1], pa.array(model.names * batch.num_rows, pa.string()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, kinds, pa.array(p[:, -1]), pa.array((p[:, -1] >= ACCEPT).astype(np.int32))], [*names, "categories", "score", "toxic"])

    return df.mapInArrow(score, with_fields(df, "categories map<string,double>, score double, toxic int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(documents, read_table(spark, sf_dir, "labels"))
    return score_toxicity(documents.select("doc_id", "text"), model).select("doc_id", is_held_out("doc_id").alias("held_out"), "categories", "score", "toxic")
