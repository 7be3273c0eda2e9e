"""Language identification by error-correcting output codes.

Each language has a codeword of plus and minus ones.  For each bit a linear
classifier over hashed byte trigrams of the lower-cased letters tells the
languages with a plus from those with a minus; its weights are the smoothed
log-odds of the two unions, each language weighing the same.  They follow from
trigram counts per language, which are counted over every eligible document and
summed before they leave a task, so nothing is sampled.  A text's margin on a
bit is the mean weight of its trigrams, scaled by the margin expected.  Decoding
takes the codeword with the least exponential loss, each bit weighing as much as
it is expected to tell for that language; a small gap to the runner-up flags
ambiguity.

Defined results: null text, or text without a letter, is ``und`` with score 0;
with nothing learned every text is ``und``; equal losses go to the first language
by code point; rows that repeat get equal results; an empty table gives an empty
result; very long texts are counted whole.  A letter is a character of a Unicode
category of letters.  All languages are learned: the driver holds 16384 counts of each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import documents, fold_of, with_arrow_columns

BUCKETS = 1 << 14
GAP = 0.2
_WORD_CHARACTER = re.compile(r"[^\W\d_]")
_ONLY_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is of a category of letters; fractions, superscripts and Roman numerals aren't."""
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed trigrams, or None if there is no letter."""
    if not text or not has_letter(text):
        return None
    raw = b" " + b" ".join(text.lower().encode().translate(_ONLY_LETTERS).split()) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761) >> np.uint32(18)
    return np.bincount(h, minlength=BUCKETS)


def codewords(n: int) -> np.ndarray:
    """n codewords: every split into two sides up to five languages, then about 12 log2 n random splits, the best of 50 draws."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = range(2 ** (n - 1) - 1)
        return np.array([[1 if i == 0 or s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)], float)
    width, best = int(np.ceil(12 * np.log2(n))), (-1, None)
    rng = np.random.default_rng(5)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        code[0, np.abs(code.sum(0)) == n] *= -1  # no bit may be the same for all
        apart = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    importance: np.ndarray

    def losses(self, counts: np.ndarray) -> np.ndarray:
        z = counts @ self.weights / max(1, counts.sum()) / self.scale
        return (self.importance * np.exp(-np.clip(self.code * z, -3, 3))).sum(1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether it's ambiguous."""
        counts = trigram_counts(text) if self.langs else None
        if counts is None:
            return "und", 0.0, True
        loss = self.losses(counts)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-4 * (loss - loss[order[0]]))
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.langs[order[0]], float(1 / share.sum()), bool(gap < GAP)


def fit(counts: dict[str, np.ndarray]) -> Model:
    """``counts``: per language, the trigram counts of its texts."""
    langs = sorted(counts)
    if not langs:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1)), np.ones(1), np.ones((0, 1)))
    p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in langs])
    code = codewords(len(langs))
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.log(p.T @ up / np.maximum(1, up.sum(0)) + 1e-12) - np.log(p.T @ down / np.maximum(1, down.sum(0)) + 1e-12)
    expected = p @ weights
    tells = np.maximum(code * expected, 0)
    importance = tells / np.maximum(tells.sum(1, keepdims=True), 1e-12)
    return Model(langs, code, weights, np.maximum(np.abs(expected).mean(0), 1e-9), importance)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if (c := trigram_counts(text)) is not None:
                total[lang] += c
    for lang, c in total.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs`` (text, lang) that have a language."""
    sums = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    found = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    named = found.column("lang").combine_chunks().dictionary_encode()
    lang, bucket, n = (x.to_numpy(zero_copy_only=False) for x in (named.indices, found.column("bucket").combine_chunks(), found.column("n").combine_chunks()))
    order = np.argsort(lang, kind="stable")
    cut = np.searchsorted(lang[order], np.arange(len(named.dictionary) + 1))
    counts = {}
    for i, name in enumerate(named.dictionary.to_pylist()):
        at = order[cut[i] : cut[i + 1]]
        counts[name] = np.bincount(bucket[at], n[at], minlength=BUCKETS)
    return fit(counts)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list[pa.Array]:
        got = [sent.value.predict(t) for t in texts.to_pylist()]
        lang, score, ambiguous = zip(*got, strict=True) if got else ((), (), ())
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())]

    return with_arrow_columns(docs, work, "lang_pred string, lang_score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without texts that have no language or whose language is a toss-up.

    A toss-up is ambiguous and has a score under ``least``.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" if n != "text" else n for i, n in enumerate(names)])
    kept = identified(plain, model).where("lang_pred <> 'und' AND NOT (ambiguous AND lang_score < %r)" % least)
    return kept.select(*plain.columns).toDF(*names)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.where(fold_of(F.col("doc_id"), 3) != 1))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "ambiguous")
