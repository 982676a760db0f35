"""Text expressions: tokens, hashed buckets, statements, score formatting.

All native Spark SQL functions. The same definitions are written in DuckDB SQL
for the oracle, so they are kept deliberately simple and engine-neutral:

* tokens     = lower-case, every run of characters that are neither letters nor
               digits becomes one space, trim, split on space, drop empties
* bucket     = first 4 hex digits of md5(UTF-8 token) as an integer, mod dim
* statements = split on runs of ``.``, ``!``, ``?`` or newline, trim spaces,
               keep the pieces that hold at least one token
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cached_column
from .vectors import let

ColumnOrName = Column | str

# Fixed values (tokenizer and statement splitter; the oracle SQL uses the same)
NON_WORD = r"[^\p{L}\p{N}]+"
WORD_CHAR = r"[\p{L}\p{N}]"
STATEMENT_BREAK = "[.!?\\n]+"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cached_column
def tokens(text: ColumnOrName) -> Column:
    """array<string> of tokens; empty array for empty text, null for null."""
    cleaned = F.trim(F.regexp_replace(F.lower(_c(text)), NON_WORD, " "))
    # array_remove is a plain (codegen) expression; a filter lambda is interpreted per element
    return F.array_remove(F.split(cleaned, " "), "")


def token_bucket(tok: Column, dim: int) -> Column:
    return F.conv(F.substring(F.md5(tok), 1, 4), 16, 10).cast("int") % F.lit(dim)


def buckets(text: ColumnOrName, dim: int) -> Column:
    return F.transform(tokens(text), lambda t: token_bucket(t, dim))


def bucket_counts(bucket_ids: Column, dim: int) -> Column:
    """Dense ``array<float>`` of per-bucket counts (exact small integers).

    The bucket array is bound once (see ``vectors.let``): referenced directly
    inside the per-bucket lambda it would be recomputed ``dim`` times per row.
    (Writing the ``dim`` counts out as separate expressions runs ~30% faster
    but makes plans so large that analysis costs more than it saves.)
    """
    return let(bucket_ids, lambda bs: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (F.size(bs) - F.size(F.array_remove(bs, i))).cast("float")))


@cached_column
def hash_embedding(text: ColumnOrName, dim: int) -> Column:
    """The offline stand-in embedder as one native expression (null text -> null)."""
    return F.when(_c(text).isNotNull(), bucket_counts(buckets(text, dim), dim))


@cached_column
def statements(text: ColumnOrName) -> Column:
    """array<string> of statements in text order."""
    parts = F.transform(F.split(_c(text), STATEMENT_BREAK), lambda s: F.trim(s))
    # a piece holds a token exactly when it holds a letter or a digit
    return F.filter(parts, lambda s: s.rlike(WORD_CHAR))


@cached_column
def longest_statement(text: ColumnOrName) -> Column:
    """The longest statement (characters; the first of equals), the empty string if there is none."""
    return F.aggregate(F.coalesce(statements(text), F.array().cast("array<string>")), F.lit(""),
                       lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best))


@cached_column
def distinct_tokens(text: ColumnOrName) -> Column:
    return F.array_distinct(tokens(text))


def token_coverage(part: Column, whole: Column) -> Column:
    """|distinct(part) ∩ distinct(whole)| / |distinct(part)| for token arrays; null if part is empty.

    ``array_intersect(a, b)`` hashes ``b`` and probes it with ``a``; its result
    is distinct. The (short) part is the hashed side, so a statement checked
    against a large context vocabulary costs one probe per context token
    instead of rebuilding a set of the whole vocabulary.
    """
    return let(F.array_distinct(part), lambda p: F.try_divide(
        F.size(F.array_intersect(whole, p)).cast("double"), F.size(p).cast("double")))


def format_score(score: ColumnOrName, decimals: int = 4) -> Column:
    """Fixed-decimal text of a score."""
    return F.format_string(f"%.{decimals}f", _c(score))
