"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are complete, of one depth, and flattened: TREES x (2**DEPTH - 1) features and thresholds in heap order and
TREES x 2**DEPTH leaves, so a batch of rows goes down all trees level by level in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import is_held_out, labelled_sample, mix, passes, read_table, span_hashes, texts_of, with_fields, word_bounds

#: Bound on the labelled rows that are learned from.
MOST_LABELLED = 20_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, RIDGE, LEAST_ROWS = 0.2, 4.0, 12
#: A text is predicted good from this score on.
ACCEPT = 0.3
FEATURES = ("words", "word_bytes", "upper", "digit", "symbol", "exclaim", "comma_stop", "other_sign", "high", "line_words", "distinct_words", "distinct_triples", "top_word", "line_repeat", "bar", "short_words")

_CLASS = np.full(256, 7, np.int64)
_CLASS[[*range(65, 91)]] = 0
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[list(b"#*$%&<>")] = 3
_CLASS[list(b"!")] = 4
_CLASS[list(b".,")] = 5
_CLASS[list(b"|")] = 6
_CLASS[128:] = 8
_CLASS[[0x20, *range(0x09, 0x0E)]] = 9
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True


def _distinct(values: np.ndarray, at: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the largest count of one, in each range of values without its last ones."""
    n, top = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:] - less, strict=True)):
        if b > a:
            _, counts = np.unique(values[a:b], return_counts=True)
            n[k], top[k] = len(counts), counts.max()
    return n, top


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of FEATURES; an empty text has zeros in all."""
    out = []
    for begin, end in passes(offsets):
        part, at = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        rows = end - begin
        of_row = np.repeat(np.arange(rows), np.diff(at))
        kinds = np.bincount(of_row * 10 + _CLASS[part], minlength=rows * 10).reshape(rows, 10).astype(float)
        starts, ends, first = word_bounds(part, at)
        n = np.diff(first).astype(float)
        hashes = span_hashes(part, starts, ends)
        triples = hashes.copy()
        if len(hashes) > 2:
            triples[:-2] = mix(hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(7))
        words, top = _distinct(hashes, first)
        threes, _ = _distinct(triples, first, 2)
        l_starts, l_ends, l_first = word_bounds(part, at, _LINE_END)
        lines = np.diff(l_first).astype(float)
        each_line, _ = _distinct(span_hashes(part, l_starts, l_ends), l_first)
        short = np.add.reduceat(np.append((ends - starts) <= 2, 0), np.minimum(first[:-1], len(starts))) * (n > 0) if len(starts) else n
        size, some, some_lines = np.maximum(np.diff(at), 1), np.maximum(n, 1), np.maximum(lines, 1)
        letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
        out.append(
            np.stack(
                [np.log1p(n), (np.diff(at) - kinds[:, 9]) / some, kinds[:, 0] / letters, kinds[:, 2] / size, kinds[:, 3] / some, kinds[:, 4] / some, kinds[:, 5] / some, kinds[:, 7] / some, kinds[:, 8] / size, n / some_lines, words / some, threes / some, top / some, 1 - each_line / some_lines, kinds[:, 6] / some, short / some],
                axis=1,
            )
            * (np.diff(at) > 0)[:, None]
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """A flattened ensemble; start is the log odds before any tree."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all trees at once level by level."""
        trees, depth = len(self.leaf), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        node = np.zeros((len(x), trees), np.int64)
        each, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[each, node]] > self.threshold[each, node])
        total = self.start + (self.leaf[each, node - (2**depth - 1)].sum(axis=1) if trees else 0.0)
        return 1 / (1 + np.exp(-np.clip(total + np.zeros(len(x)), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees on logistic loss; splits are sought on histograms of at most BINS quantile bins a feature.

    With fewer than two labels there is nothing to tell apart: the score is the share of label 1, and 1 without rows.
    """
    share = float(y.mean()) if len(y) else 1.0
    start = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not 0 < share < 1:
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(x), start)
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            place = node - first
            best = np.full(width, 1e-9)
            pick = [(0, -1)] * width
            for f in range(x.shape[1]):
                key = place * BINS + binned[:, f]
                g, h, c = (np.cumsum(np.bincount(key, w, width * BINS).reshape(width, BINS), axis=1) for w in (grad, hess, None))
                gain = g**2 / (h + RIDGE) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(c < LEAST_ROWS) | (c[:, -1:] - c < LEAST_ROWS)] = 0
                gain[:, len(cuts[f]) :] = 0
                for k in range(width):
                    b = int(gain[k].argmax())
                    if gain[k, b] > best[k]:
                        best[k], pick[k] = gain[k, b], (f, b)
            for k, (f, b) in enumerate(pick):
                if b >= 0:
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
        place = node - inner
        g, h = np.bincount(place, grad, leaves), np.bincount(place, hess, leaves)
        leaf[t] = RATE * g / (h + RIDGE)
        total += leaf[t, place]
    return Trees(start, feature, threshold, leaf)


def train(documents: DataFrame, labels: DataFrame, bound: int = MOST_LABELLED) -> Trees:
    """Learn from about bound labelled rows; only their statistics reach the driver, in doc_id order.

    Rows without doc_id have no label and are not learned from. A document that repeats a doc_id counts once a row;
    ties in doc_id change the order of sums at most. Columns of documents besides doc_id and text are ignored, also
    one named quality.
    """

    def gather(batches):
        for batch in batches:
            x = text_features(*texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    sample = labelled_sample(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels.select("doc_id", F.col("quality").cast("int").alias("quality")), ["quality"], bound, 8)
    rows = sample.select("doc_id", "quality", "text").mapInArrow(gather, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit_trees(x, (rows["quality"].to_numpy() > 0).astype(float))


def score_quality(documents: DataFrame, model: Trees) -> DataFrame:
    """documents plus score (0 to 1) and predicted (1 from ACCEPT on), from whole texts in one pass without a shuffle.

    Null and empty texts have all statistics zero and get that score. Rows are scored one by one, so a null or
    repeated doc_id changes nothing, and equal texts tie. Columns of those names are replaced, all others are kept.
    """
    df = documents.drop("score", "predicted")
    names = df.columns

    def score(batches):
        for batch in batches:
            p = model.score(text_features(*texts_of(batch.column(names.index("text")))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= ACCEPT).astype(np.int32))], [*names, "score", "predicted"])

    return df.mapInArrow(score, with_fields(df, "score double, predicted int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a row without doc_id is in no fold, so held_out is false."""
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(documents, read_table(spark, sf_dir, "labels"))
    return score_quality(documents, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
