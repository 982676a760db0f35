"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Base rules fail a text of fewer than ``MIN_WORDS`` words, or one of which more
than half the words stand in 3-word windows that occur twice or more.

The method compares two multinomials over hashed unigrams and bigrams: the
trusted target and the raw corpus, both counted over all their texts. A
document's score is the mean log-likelihood ratio of its n-grams (length
normalised, nats per n-gram); every document at or above ``THRESHOLD`` is
kept. The table of ratios is rounded to ``DIGITS`` decimals, so that verdicts
don't depend on summation details of the platform.

Only built-in functions run. The corpus is read twice (counts, then scores);
the counts are combined before the shuffle and only ``BUCKETS`` sums reach the
driver. The trusted texts are found by a semi-join on the document id, whose
ids are broadcast where they are counted to fit.

Defined cases: a null text is empty (all counts 0, base failed, score null); a
trusted set without words gives every document the score 0; repeated rows are
judged one by one; empty tables give empty results; extra columns pass
through, and columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, semi_join, text_or_empty
from .native import let

SPACES = " \t\n\u000b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
BUCKETS = 10_000
#: Added to each count, so that no bucket is empty.
SMOOTHING = 1.0
#: Nats per n-gram; texts like the trusted ones score about 0 or more.
THRESHOLD = -0.05
DIGITS = 6


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN, -1), lambda w: w != "")


def _pairs(words: Column, n: int, body) -> Column:
    """``body(i)`` for every window of n words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), body))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = F.coalesce(_pairs(words, 3, lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))), F.array().cast("array<bigint>"))

    def among(s):
        twice = F.filter(F.transform(s, lambda x, i: F.when(
            (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])), x["i"])),
            lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))

    def count(h):
        paired = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(paired, among)).cast("long")

    return let(windows, count)


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the unigrams and bigrams of a word array."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    double = _pairs(words, 2, lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)),
                                               F.lit(buckets)).cast("int"))
    return F.concat(single, F.coalesce(double, F.array().cast("array<int>")))


def gram_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Occurrences of each bucket over all texts."""
    rows = docs.select(F.explode(let(words_of(text_or_empty(text_col)), lambda w: gram_buckets(w, buckets))).alias("b")) \
        .groupBy("b").count().collect()
    out = [0] * buckets
    for r in rows:
        out[r["b"]] = r["count"]
    return out


def ratios(target: list[int], raw: list[int], smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of each bucket."""
    if not sum(target):
        return [0.0] * len(raw)
    t, r = sum(target) + smoothing * len(target), sum(raw) + smoothing * len(raw)
    return [round(math.log((a + smoothing) / t) - math.log((b + smoothing) / r), DIGITS)
            for a, b in zip(target, raw, strict=True)]


def judge(docs: DataFrame, table: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the base counts, ``base_failed``, ``llr`` (null without words) and ``kept``."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    text = text_or_empty(text_col)

    def score(w):
        def mean(b):
            total = F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(values, x))
            return F.when(F.size(b) > 0, F.round(total / F.size(b), DIGITS))
        return let(gram_buckets(w, len(table)), mean)

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({
        "__m": let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"), score(w).alias("s"))),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")})
    out = out.withColumns({"n_words": F.col("__m.n"), "n_repeat_words": F.col("__m.r"), "llr": F.col("__m.s")}) \
        .drop("__m")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= threshold))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; trusted are the documents labelled with quality 1."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where("quality = 1").select("doc_id")
    table = ratios(gram_counts(semi_join(docs, trusted, "doc_id")), gram_counts(docs))
    return judge(docs, table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept", "llr")
