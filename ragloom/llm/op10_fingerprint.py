"""Document fingerprints by spot signatures.

A spot is a common word (anchor) followed by a chain of the next ``CHAIN``
words that are no anchors. The hashes of a document's spots are its signature
set; its fingerprint is that set, sorted and joined. Spots follow the running
text and skip lists, menus and numbers, so an edited passage changes few.

Sets are compared by Jaccard similarity, pruned by length: two sets of n and m
spots share at most min(n, m) / max(n, m), so sets are dealt into length
partitions, and pairs whose partitions bound the similarity below the floor
asked for are not compared (``pruned_jaccard`` gives 0 for them).

Only built-in functions run. Anchors are the commonest words of the languages
at hand, a parameter. A text with few spots (a short one, a list, another
language) adds its words, their chains or, without two words, itself, so that
texts that differ hardly ever have equal fingerprints.

Defined cases: a null text is empty; repeated rows are fingerprinted one by
one; two empty texts are alike (1.0); empty tables give empty results; extra
columns pass through, and columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_documents, text_or_empty
from .native import let

#: Common words that start a spot (English, German, French, Spanish).
ANCHORS = ("the", "of", "and", "to", "is", "der", "die", "und", "den", "ist", "le", "la", "les", "et", "est",
           "el", "los", "que", "y", "es")
CHAIN = 2
#: With fewer spots, or less than one in so many words, a text's words and all their chains count too.
MIN_SPOTS, FEW = 4, 25
#: A chain may run over so many anchors.
OVER = 3
#: Factor between the lengths of neighbouring length partitions.
STEP = 1.25
ROWS_PER_BUCKET = 4000
#: Buckets of ids at most (their bounds are constants of the plan); beyond, buckets hold more rows.
MAX_BUCKETS = 20_000
NO_ID = -(1 << 63)
_MARK = "\u0001"


def spot_signatures(text: Column, anchors=ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct spot hashes (8 hex digits each) of a text."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(plain, f" (?:{'|'.join(anchors)})(?= )", _MARK)
    first = r"^ *(\S+" + r" +\S+" * (chain - 1) + ")"

    def short_hash(x):
        return F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")

    def spots(parts):
        chains = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.regexp_extract(
            F.array_join(F.slice(parts, i + 1, OVER + 1), ""), first, 1))
        return F.when(F.size(parts) > 1, F.filter(chains, lambda c: c != "")).otherwise(F.array().cast("array<string>"))

    def all_words(words):
        chains = F.when(F.size(words) >= chain, F.transform(
            F.sequence(F.lit(1), F.size(words) - chain + 1),
            lambda i: F.array_join(F.slice(words, i, chain), " "))).otherwise(F.array(text))
        return F.concat(words, chains)

    def hashes(found):
        return F.array_sort(F.array_distinct(F.transform(found, short_hash)))

    blanks = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    words = F.filter(F.split(F.translate(plain, _MARK, " "), " "), lambda w: w != "")
    return let(let(F.split(marked, _MARK, -1), spots),
               lambda s: F.when((F.size(s) >= MIN_SPOTS) & (F.size(s) * FEW >= blanks), hashes(s)).otherwise(
                   hashes(F.concat(s, let(words, all_words)))))


def length_partition(signatures: Column) -> Column:
    """Partition of a set by its length; neighbouring partitions differ by the factor ``STEP``."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / math.log(STEP)).cast("int")


def pruned_jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two distinct sets; 0 if their length partitions bound it below ``floor``."""
    def compare(x):
        n, m = F.size(x["a"]), F.size(x["b"])
        near = F.abs(length_partition(x["a"]) - length_partition(x["b"])) <= (
            F.lit(math.ceil(math.log(1 / floor) / math.log(STEP)) + 1) if floor > 0 else F.lit(1 << 30))
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when(near & (F.least(n, m) >= floor * F.greatest(n, m)),
                      both / F.greatest(n + m - both, F.lit(1))).otherwise(0.0)
    return let(F.struct(a.alias("a"), b.alias("b")), compare)


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "spots") -> DataFrame:
    """Add the signature set of ``text_col``."""
    return df.withColumn(out_col, spot_signatures(text_or_empty(text_col)))


def bucket_bounds(docs: DataFrame, id_col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[int]:
    """Ascending ids that cut the table into buckets of about ``rows_per_bucket`` rows."""
    n = docs.count()
    k = min(n // rows_per_bucket, MAX_BUCKETS)
    if k < 1:
        return []
    at = F.split(F.lit(",".join(str(i / (k + 1)) for i in range(1, k + 1))), ",").cast("array<double>")
    got = docs.select(F.percentile_approx(id_col, at, F.lit(10 * (k + 1)))).first()[0]
    return sorted(set(got or ()))


def bucket_of(value: Column, bounds: list[int], group: int = 64) -> Column:
    """Number of bounds at or below the value, found in two steps."""
    if not bounds:
        return F.lit(0)

    def constant(values):
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    every = constant(bounds)
    coarse = F.size(F.filter(constant(bounds[::group]), lambda b: b <= value))
    before = F.greatest((coarse - 1) * group, F.lit(0))
    return before + F.size(F.filter(F.slice(every, before + 1, F.lit(group)), lambda b: b <= value))


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``doc_id, text, spots, next_text, next_spots``: every document with its successor by doc_id.

    After the last document comes the first; equal ids are ordered by text; a
    null id comes first. Texts are dealt once, by ranges of ids; the successor
    of a bucket's last row is the first row of the next bucket.
    """
    rows = docs.select("doc_id", text_or_empty("text").alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"))
    bounds = bucket_bounds(rows.select("__id"), "__id", rows_per_bucket)
    keyed = rows.withColumn("__b", bucket_of(F.col("__id"), bounds))
    ids = keyed.groupBy("__b").agg(F.min("__id").alias("__id"))
    # one row per bucket, so this window is as small as the list of bounds
    after = ids.select(F.col("__b").alias("__after"), F.col("__id").alias("__first"),
                       F.lag("__b").over(Window.orderBy("__b")).alias("__b"), F.max("__b").over(
                           Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                       .alias("__last"))
    after = after.select(F.coalesce("__b", "__last").alias("__to"), F.col("__first").alias("__id"))
    first = rows.join(F.broadcast(after), "__id").groupBy("__to").agg(F.min("text").alias("__first"))
    first = fingerprint(first, "__first", "__first_spots").withColumnRenamed("__to", "__b")
    order = Window.partitionBy("__b").orderBy("__id", "text")
    dealt = fingerprint(keyed.repartition("__b")).withColumns({
        "next_text": F.lead("text").over(order), "next_spots": F.lead("spots").over(order)})
    return dealt.join(first, "__b").select(
        "doc_id", "text", "spots", F.coalesce("next_text", "__first").alias("next_text"),
        F.when(F.col("next_text").isNull(), F.col("__first_spots")).otherwise(F.col("next_spots")).alias("next_spots"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    rows = with_next(read_documents(spark, sf_dir).select("doc_id", "text"))
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - moved),
                                              F.substring(F.col("next_text"), F.lit(1), moved)))
    rows = fingerprint(rows.select("doc_id", "spots", "next_spots", n.cast("long").alias("n_chars"), "edited"),
                       "edited", "edited_spots")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("spots", "").alias("fingerprint"), F.array_join("edited_spots", "").alias("edited_fingerprint"),
        pruned_jaccard(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        pruned_jaccard(F.col("spots"), F.col("next_spots")).alias("near_next"))
