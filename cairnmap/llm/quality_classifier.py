"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a document (lengths, shares of kinds of bytes, repetition, line
shape) come from its whole text in one Arrow pass.  The trees are fitted on the
driver from at most ``max_rows`` labelled rows, chosen by the hash of their id;
what is collected is that many rows of statistics, never texts.  Each tree is a
complete binary tree laid out in arrays, so a batch of documents walks all trees
with a few numpy gathers per level.

Defined results: null and empty texts have all-zero statistics and get a score;
labels without a quality are not used; an id labelled twice counts as its mean,
rounded up; with labels of one kind only, or none, every score is the smoothed
share of ones (0.5 for none); an empty table gives an empty result; equal gains go
to the first statistic and the least bin; a very long text is one row, read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import byte_views, documents, fold_of, with_arrow_columns

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "longest_word", "unique_words", "unique_pairs", "words_per_line",
    "repeated_lines", "short_lines", "upper", "lower", "digits", "marks", "stops", "symbols", "bars", "bangs", "other_bytes",
    "entropy", "capital_words", "odd_ends", "mixed_words", "most_common",
)


def _bytes_of(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_STOPS, _SYMBOLS = _bytes_of(".,;:?'\"()-"), _bytes_of("#*$%&<>@^~=+/\\_{}[]")


def _statistics(text: str, raw: np.ndarray) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    hist = np.bincount(raw, minlength=256)
    share = hist[hist > 0] / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    marks = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:?!" for w in words)
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), min(lengths.max(), 200.0), len(counts) / n, len(set(zip(words, words[1:], strict=False))) / n, n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 40 for x in lines) / max(1, len(lines)), hist[65:91].sum() / size, hist[97:123].sum() / size, hist[48:58].sum() / size, marks / size,
        hist[_STOPS].sum() / size, hist[_SYMBOLS].sum() / size, hist[124] / size, hist[33] / size, hist[128:].sum() / size,
        float(-(share * np.log(share)).sum()), sum(map(str.isupper, words)) / n, odd / n, sum(not w.isalpha() for w in words) / n, max(counts.values()) / n,
    ]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text of an Arrow string column."""
    raw, cut = byte_views(column)
    rows = [_statistics(t or "", raw[cut[i] : cut[i + 1]]) for i, t in enumerate(column.to_pylist())]
    return np.array(rows, np.float32).reshape(len(rows), len(FEATURES))


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays of (tree, node)."""

    edges: list[np.ndarray]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)]).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.feature.size and len(x):
            binned, rows = self.binned(x), np.arange(len(x))
            inner = self.feature.shape[1]
            for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
                at = np.zeros(len(x), np.int64)
                while at[0] < inner:  # all rows are on one level
                    at = 2 * at + 1 + (binned[rows, f[at]] > t[at])
                out += v[at - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss, with gradient histograms per node and bin."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    ones = float(y.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    inner = 2**depth - 1
    if not 0 < ones < n:
        return Trees([np.zeros(0)] * k, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int16), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(k)]
    model = Trees(edges, np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), bins, np.int16), np.zeros((n_trees, inner + 1)), base)
    binned, out = model.binned(x).astype(np.int64), np.full(n, base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-out))
        grad, hess, at = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local, best = at - first, np.full(width, 1e-6)
            for f in range(k):
                cell = local * bins + binned[:, f]
                g, h, c = (np.bincount(cell, w, minlength=width * bins).reshape(width, bins) for w in (grad, hess, None))
                gl, hl, cl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1], c.cumsum(1)[:, :-1]
                gt, ht, ct = g.sum(1, keepdims=True), h.sum(1, keepdims=True), c.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                cut = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(width), cut] > best)
                best[better] = gain[better, cut[better]]
                model.feature[t, first + better], model.threshold[t, first + better] = f, cut[better]
            at = 2 * at + 1 + (binned[np.arange(n), model.feature[t, at]] > model.threshold[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, minlength=inner + 1), np.bincount(leaf, hess, minlength=inner + 1)
        model.value[t] = -rate * g / (h + ridge)
        out += model.value[t][leaf]
    return model


def _collect_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(b.column("text"))
        yield pa.record_batch([b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **shape) -> Trees:
    """Fit on ``labels`` (doc_id, label) that have a document, ``max_rows`` at most."""
    clean = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("_d"), "text").join(F.broadcast(chosen), F.col("_d") == F.col("doc_id")).select("text", "label")
    rows = texts.mapInArrow(_collect_statistics, "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, len(FEATURES))
    y = np.array(rows.column("label").to_pylist(), np.float64)
    order = np.lexsort((y, *x.T)) if len(x) else slice(None)  # tasks end in any order
    return fit(x[order], y[order], **shape)


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with a column score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_arrow_columns(docs, lambda texts: [pa.array(sent.value.scores(statistics(texts)), pa.float64())], "score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of(F.col("doc_id"), 4) != 2)
    model = train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    out = scored(docs, model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
