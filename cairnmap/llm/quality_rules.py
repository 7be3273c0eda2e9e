"""Quality rules: base counts and a hashed n-gram log-likelihood ratio (native).

A document's score is the mean, over its word unigrams and bigrams hashed to
``buckets``, of log p(bucket | trusted) - log p(bucket | raw), with both
multinomials counted over all documents and smoothed by one.  Trusted documents
are those that pass the base rules with room to spare (``strict``); a caller can
give a predicate of its own.  A document stays if its score is at least the
trusted documents' mean less ``deviations`` standard deviations, so the verdict
is a fixed threshold, the same for each run.

The table of ratios is one array of ``buckets`` doubles (a scalar subquery), the
only thing sent to the executors; its size is a parameter.

Repeated three-word windows are found in place: a document whose windows' 64-bit
hashes are all distinct has none; in the others a window's hash and its position
share one long, the longs are sorted, and equal neighbours are repeats.  That hash
keeps 64 less log2(words) bits, 55 for 500 words and 44 for a million.

Defined results: null or empty text has no words and fails the base rules; rows
that repeat are judged each for itself; an empty table gives an empty result;
where no document is trusted all ratios are 0 and only base rules decide; a score
equal to the threshold passes; a very long text is one row of arrays of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import SPACE_CLASS, documents, small_reads, stored

SYMBOLS = "#*$%&|<>"
WORD_CHAR = f"[^{SPACE_CLASS}]"
BUCKETS = 8192
DEVIATIONS = 4.0


def _tail(array: Column, start: int, size: Column) -> Column:
    """Elements from 1-based ``start`` on."""
    return F.slice(array, start, F.greatest(size - (start - 1), F.lit(0)))


def _left(other: str) -> Column:
    """Characters of the text without the runs that a pattern matches; of a long text this keeps no list of matches."""
    return F.char_length(F.regexp_replace("_t", other, ""))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _t (text), _w (word hashes), _g2 (bigram hashes) and _chars (characters in words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    out = docs.withColumn("_t", text).withColumn("_words", words).withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_chars", F.char_length(F.array_join("_words", ""))).drop("_words")
    pairs = F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), _tail(F.col("_w"), 2, F.size("_w")), lambda a, b: F.xxhash64(a, b))
    return out.withColumn("_g2", pairs)


def with_base(docs: DataFrame, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(WORD_CHAR))
    threes = F.zip_with(F.slice("_g2", 1, F.greatest(F.size("_g2") - 1, F.lit(0))), _tail(F.col("_w"), 3, F.size("_w")), lambda a, b: F.xxhash64(a, b))
    packed = F.transform("_g3", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long")))
    twins = F.zip_with(
        F.slice("_sorted", 1, F.greatest(F.size("_sorted") - 1, F.lit(0))),
        _tail(F.col("_sorted"), 2, F.size("_sorted")),
        lambda a, b: F.when(F.call_function("shiftright", a, F.col("_bits")) == F.call_function("shiftright", b, F.col("_bits")), F.array(a, b)),
    )
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    return (
        docs.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.col("_chars").cast("long"))
        .withColumn("n_symbols", _left(f"[^{SYMBOLS}]+").cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_bits", F.length(F.bin(F.size("_w").cast("long"))))
        .withColumn("_g3", threes)
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_g3")) < F.size("_g3"), F.sort_array(packed)))
        .withColumn("_twins", F.array_distinct(F.flatten(F.array_compact(twins))))
        .withColumn("_places", F.array_distinct(F.flatten(F.transform("_twins", lambda x: F.array(place(x), place(x) + 1, place(x) + 2)))))
        .withColumn("n_repeat_words", F.when(F.col("_places").isNotNull(), F.size("_places")).otherwise(F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat))
        .drop("_lines", "_bits", "_g3", "_sorted", "_twins", "_places")
    )


def strict() -> Column:
    """Documents with room to spare: the default target.  It needs no other column than ``_t`` and ``_w``."""
    chars = F.greatest(F.char_length("_t"), F.lit(1))
    return (F.size("_w") >= 100) & (_left(f"[^{SYMBOLS}!]+") * 500 <= chars) & (_left(r"\P{Lu}+") * 10 <= chars) & (F.size(F.array_distinct("_w")) * 4 >= F.size("_w"))


def _ratio_sum(hashes: str, table: str, buckets: int) -> Column:
    return F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(F.col(table), F.pmod(h, F.lit(buckets)).cast("int")))


def ratio_table(docs: DataFrame, trusted: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array _ratio, counted over all of ``docs``."""
    grams = with_words(docs.select("text")).withColumn("_ok", strict() if trusted is None else trusted)
    each = grams.select("_ok", F.explode(F.concat("_w", "_g2")).alias("g")).select("_ok", F.pmod("g", F.lit(buckets)).alias("b"))
    counts = each.groupBy("b").agg(F.count("*").alias("raw"), F.count(F.when(F.col("_ok"), 1)).alias("good"))
    row = counts.agg(F.collect_list(F.struct("b", "raw", "good")).alias("c"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"all_{x}") for x in ("raw", "good")])
    zero = F.lit(0).cast("long")
    absent = F.array_except(F.sequence(zero, F.lit(buckets - 1).cast("long")), F.transform("c", lambda x: x["b"]))
    row = row.withColumn("c", F.sort_array(F.concat("c", F.transform(absent, lambda b: F.struct(b.alias("b"), zero.alias("raw"), zero.alias("good"))))))
    ratio = lambda x: F.log((x["good"] + 1) / (F.col("all_good") + buckets)) - F.log((x["raw"] + 1) / (F.col("all_raw") + buckets))
    return row.select(F.transform("c", lambda x: F.when(F.col("all_good") > 0, ratio(x)).otherwise(F.lit(0.0))).alias("_ratio"))


def judged(docs: DataFrame, trusted: Column | None = None, buckets: int = BUCKETS, deviations: float = DEVIATIONS) -> DataFrame:
    """``docs`` (doc_id, text) with the base counts, score, threshold and kept."""
    small_reads(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = ratio_table(docs, trusted, buckets).scalar()
    scored = with_words(docs).withColumn("_ratio", table).withColumn("_ok", strict() if trusted is None else trusted)
    grams = F.size("_w") + F.size("_g2")
    total = _ratio_sum("_w", "_ratio", buckets) + _ratio_sum("_g2", "_ratio", buckets)
    scored = scored.withColumn("score", F.when(grams > 0, total / grams).otherwise(F.lit(0.0)))
    kept = stored(with_base(scored).drop("_t", "_w", "_g2", "_chars", "_ratio", "text"), "judged")
    limit = kept.where("_ok").agg((F.avg("score") - deviations * F.coalesce(F.stddev_pop("score"), F.lit(0.0))).alias("t")).scalar()
    low = F.coalesce(limit, F.lit(float("-inf")))
    return kept.withColumn("threshold", low).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold"))).drop("_ok")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
