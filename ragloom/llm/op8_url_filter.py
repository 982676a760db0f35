"""URL filters: host and path rules, then a Bloom filter cascade over the corpus's keys.

The longest rule that fits a url decides. Every other url is blocked exactly
if its key (host and path) is on the block list. The list is held as a cascade
of Bloom filters: level 1 encodes the listed keys; level 2 those other keys of
the corpus that level 1 takes for listed; level 3 the listed keys that level 2
takes for such; and so on until a level makes no mistake. As the cascade is
built over the complete universe of keys, it answers exactly for each of them,
and a url is judged by the constants in its own row's expression: no join.

Filters are built by Spark (hash positions, bits or-ed per word). Their size
is known beforehand from the number of keys, about 5 bits a listed key; up to
``MAX_BITS`` they are constants of the plan. A longer list is looked up by a
semi-join on the key, with the same result.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is not listed; repeated rows are judged one by one; an empty list or an
empty table gives no block verdict of the list; extra columns pass through,
and columns named like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_documents

#: (host, path, verdict); a rule holds for the host and its subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Host labels whose pages the query lists.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: False positive rate of a level, and bits of all levels that a plan may carry.
RATE = 0.1
MAX_BITS = 1 << 24
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Level:
    """One Bloom filter: 64-bit words, number of bits and of hash functions."""
    seed: int
    bits: int
    hashes: int
    words: list[int]

    def positions(self, key: Column) -> Column:
        a, b = F.xxhash64(key, F.lit(2 * self.seed)), F.xxhash64(key, F.lit(2 * self.seed + 1))
        step = F.pmod(b, F.lit(self.bits))
        return F.array(*[F.pmod(F.pmod(a, F.lit(self.bits)) + step * j, F.lit(self.bits))
                         for j in range(self.hashes)])

    def contains(self, key: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.forall(self.positions(key), lambda p: F.call_function(
            "shiftrightunsigned", F.get(table, F.floor(p / 64).cast("int")), (p % 64).cast("int"))
            .bitwiseAND(F.lit(1).cast("bigint")) == 1)


@dataclass
class Cascade:
    """Exact membership for the keys of the universe that it was built over."""
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Odd levels say listed, even ones take it back; the first level that doesn't hold the key decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].contains(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def bits_for(n: int, rate: float = RATE) -> tuple[int, int]:
    """Bits and hash functions of a filter of n keys."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    return max(64, math.ceil(n * hashes / math.log(2))), hashes


def _build(keys: DataFrame, n: int, seed: int, rate: float) -> Level:
    bits, hashes = bits_for(n, rate)
    level = Level(seed, bits, hashes, [])
    rows = keys.select(F.explode(level.positions(F.col("key"))).alias("p")) \
        .groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("m")) \
        .collect()
    level.words = [0] * -(-bits // 64)
    for r in rows:
        level.words[r["w"]] = r["m"]
    return level


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = RATE,
                  max_bits: int = MAX_BITS) -> Cascade | None:
    """Cascade for ``listed(key)`` over ``universe(key)``; None if it would need more than ``max_bits``.

    Keys of the list that the universe doesn't have are left out: no row asks for them.
    """
    have = universe.select("key").distinct()
    wanted = listed.select("key").distinct().withColumn("listed", F.lit(True))
    keys = materialize(have.join(wanted, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")),
                       "url-keys")
    inside, outside = keys.where("listed"), keys.where("not listed")
    cascade, used = Cascade(), 0
    n = inside.count()
    while n:
        used += bits_for(n, rate)[0]
        if used > max_bits:
            return None
        level = _build(inside, n, len(cascade.levels) + 1, rate)
        cascade.levels.append(level)
        wrong = materialize(outside.where(level.contains(F.col("key"))), "false-positives")
        inside, outside = wrong, inside
        n = wrong.count()
    return cascade


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES, rate: float = RATE,
          max_bits: int = MAX_BITS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row; ``listed(key)`` holds blocked ``host || path``."""
    out = pages.withColumns({"__h": url_host(F.col(url_col)), "__p": url_path(F.col(url_col))}) \
        .withColumn("__key", F.concat("__h", "__p"))
    cascade = build_cascade(listed, out.select(F.col("__key").alias("key")), rate, max_bits)
    if cascade is None:
        on_list = listed.select(F.col("key").alias("__key")).distinct().withColumn("__on", F.lit(True))
        out = out.join(on_list, "__key", "left").withColumn("__on", F.coalesce("__on", F.lit(False)))
    else:
        out = out.withColumn("__on", cascade.contains(F.col("__key")))
    out = out.withColumn("__rule", longest_rule(F.col("__h"), F.col("__p"), rules))
    return out.withColumns({
        "host": F.col("__h"), "path": F.col("__p"), "rule": F.col("__rule.rule"),
        "verdict": F.coalesce("__rule.verdict", F.when(F.col("__on"), "block").otherwise("allow"))}) \
        .drop("__h", "__p", "__key", "__on", "__rule")


def labelled_keys(pages: DataFrame, labels=LISTED_LABELS, url_col: str = "url") -> DataFrame:
    """``key`` of every page whose host has one of ``labels``."""
    host = url_host(F.col(url_col))
    return pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels]))) \
        .select(F.concat(host, url_path(F.col(url_col))).alias("key"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict for every page."""
    pages = read_documents(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_keys(pages)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: -(len(r[0]) + len(r[1])))

    def fits(h, p):
        return f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"

    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in rules)
    listed = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    return f"""with u as (select page_id,
  translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') as host,
  coalesce(regexp_extract(url, '{_URL}', 2), '') as path from pages)
select page_id, host, path, case {rule} end as rule,
  case {verdict} when list_has_any(string_split(host, '.'), [{listed}]) then 'block' else 'allow' end as verdict
from u"""


SQL = _sql()
