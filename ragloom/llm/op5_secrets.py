"""Secret scans: key patterns plus a randomness test battery with false-discovery control.

Base kinds (leftmost, non-overlapping per kind): assignments of a value of 6
or more characters, access key ids of 20 or more, hexadecimal runs of 24 or
more. The method adds spans of kind ``random``: runs of 20 or more encoding
characters. For each run

* the encoding is inferred from its characters (hex and base36 in either case,
  base32, base64); a run with ``-`` or ``_`` that isn't base64 is judged by its
  letters, digits, ``+`` and ``/``, in classes of its own (``hex-``); any other
  run of two or more character classes is held against the base64 alphabet
  (``mixed``); a run of one class only (a word, a number) has none;
* three tests ask whether its symbols look drawn at random from that
  alphabet: chi-squared uniformity (Wilson-Hilferty), runs above and below
  the middle of the alphabet, lag-one serial correlation;
* Fisher's method combines them into one p-value, uniform on (0, 1) for a
  random string and near 0 for text.

The false-discovery control is length-aware: within each encoding and length
class, the corpus-wide histogram of p over distinct runs gives the number of
truly random runs (Storey's estimate from the upper half) and so the share of
other runs above any cut; the smallest cut with a share of at most
``FALSE_SHARE`` is taken. A class with fewer than ``ENOUGH`` runs above the
lowest bin takes the cut of its encoding's pooled histogram, else of all
encodings'; without enough runs anywhere the cut is ``FALSE_SHARE``, which a
random run misses that often. A run whose copies (``ENOUGH`` or more) are over
``FALSE_SHARE`` of its class moves no cut but its own, which comes from the
histogram over all copies: one wrong decision on it would exceed the share.

Only built-in functions run: text never leaves the JVM, nothing but the
histogram (a few thousand rows at most) reaches the driver, and of texts only
hashes of runs are shuffled. Spans are code points, end exclusive.

Defined cases: null text is empty (no spans); texts of any length are scanned
whole; repeated rows are judged one by one; equal starts sort by kind as
listed; empty tables give empty results; extra columns pass through, and
columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_documents, text_or_empty
from .native import let, match_starts, running_maxima, total, two_sided, upper_tail

#: The base patterns.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Runs that the battery judges.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 6, 20
FALSE_SHARE = 0.05
#: p-values are counted in so many bins; a cut is never below one bin.
BINS = 100
#: Distinct runs above the lowest bin from which a histogram gives a cut of its own.
ENOUGH = 30
LENGTH_CLASSES = (24, 32, 48, 64, 128)
#: Alphabets of the inferred encodings, in value order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ALPHABETS["mixed"] = ALPHABETS["base64"]
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, value_group: int | None = None) -> Column:
    """Spans of the matches of ``pattern``; ``keep(match, value)`` tells which count."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits

    def build(x):
        spans = F.zip_with(match_starts(x["p"], x["h"]), F.arrays_zip(x["h"].alias("h"), x["v"].alias("v")),
                           lambda s, z: F.struct(s.alias("start"), F.lit(kind).alias("kind"),
                                                 (s + F.length(z["h"])).alias("end"), z["v"].alias("v")))
        if keep is not None:
            spans = F.filter(spans, lambda z: keep(z["v"]))
        return F.transform(spans, lambda z: F.struct(z["start"], z["kind"], z["end"])).cast(SPAN)

    found = let(F.struct(pieces.alias("p"), hits.alias("h"), values.alias("v")), build)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, lambda v: F.length(v) >= MIN_VALUE, value_group=2),
        _spans(text, ACCESS, 1, lambda v: F.length(v) >= MIN_ACCESS),
        _spans(text, HEX, 2)))


def encoding(run: Column) -> Column:
    """The encoding of a run (padding removed), or null for a word, a number or marks only."""
    digit, lower, upper = run.rlike("[0-9]"), run.rlike("[a-z]"), run.rlike("[A-Z]")
    part = F.translate(run, "-_", "")
    one_case = digit & (lower != upper)
    kinds = sum((x.cast("int") for x in (digit, lower, upper)), run.rlike("[+/]").cast("int"))
    name = (F.when(part.rlike("^[0-9a-fA-F]+$") & digit & (lower | upper), "hex")
            .when(part.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
            .when(part.rlike("^[0-9a-zA-Z]+$") & one_case, "base36")
            .when(kinds >= 2, "mixed"))
    return F.when(digit & lower & upper & ~part.rlike("^[0-9a-fA-F]+$") & ~(run.rlike("[-_]") & run.rlike("[+/]")), "base64") \
        .otherwise(F.when(run.rlike("[-_]"), F.concat(name, F.lit("-"))).otherwise(name))


def symbols(run: Column, enc: Column) -> Column:
    """The symbols of a run that are judged: without separators, in the alphabet's case."""
    part = F.when(enc.endswith("-"), F.translate(run, "-_", "")).otherwise(run)
    return F.when(F.rtrim(enc, F.lit("-")).isin("hex", "base36"), F.lower(part)).otherwise(part)


def random_p(run: Column, alphabet: Column) -> Column:
    """Combined p-value of the battery for a run over an alphabet (see the module docstring).

    Every step is linear in the run: what all symbols share (their number, their
    mean) is bound once and not computed again for each of them.
    """
    def battery(v):
        x, n, size, mid, letters = v["x"], v["n"], v["size"], v["mid"], v["letters"]
        # chi-squared, from the count of each symbol of the alphabet
        same = total(F.transform(F.split(letters, ""), lambda c: let(
            (F.length(v["run"]) - F.length(F.replace(v["run"], c, F.lit("")))).cast("long"), lambda k: k * k)))
        df = size - 1
        chi = same * size / n - n
        uniform = upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2 / 9) / df))
                             / F.sqrt(F.lit(2 / 9) / df))
        # runs above and below the middle
        high = total(F.transform(x, lambda c: F.when(c * 2 >= size, 1).otherwise(0).cast("long"))).cast("double")
        runs = 1 + total(F.transform(x, lambda c, i: F.when(
            (i > 0) & ((c * 2 >= size) != (F.get(x, i - 1) * 2 >= size)), 1).otherwise(0).cast("long")))

        def runs_test(h):
            mean = 1 + 2 * h["high"] * (n - h["high"]) / n
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(var > 0, two_sided((h["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(0.0))

        # serial correlation at lag one
        spread = F.aggregate(x, F.lit(0.0), lambda a, c: a + (c - mid) * (c - mid))
        lagged = F.aggregate(F.transform(x, lambda c, i: F.when(
            i > 0, (c - mid) * (F.get(x, i - 1) - mid)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
        serial = let(spread, lambda d: F.when(d > 0, two_sided((lagged / d + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0)))
        # Fisher: -2 sum(ln p) is chi-squared with 6 degrees of freedom
        half = -(F.log(F.greatest(uniform, F.lit(1e-300)))
                 + F.log(F.greatest(let(F.struct(high.alias("high"), runs.alias("runs")), runs_test), F.lit(1e-300)))
                 + F.log(F.greatest(serial, F.lit(1e-300))))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    def bound(y):
        codes = F.transform(F.split(y["run"], ""), lambda c: (F.instr(y["letters"], c) - 1).cast("long"))
        return let(F.filter(codes, lambda c: c >= 0), lambda x: let(F.struct(
            x.alias("x"), F.size(x).cast("double").alias("n"), F.length(y["letters"]).cast("double").alias("size"),
            (total(x) / F.size(x).cast("double")).alias("mid"), y["run"].alias("run"), y["letters"].alias("letters")), battery))

    return let(F.struct(F.translate(run, "-_", "+/").alias("run"), alphabet.alias("letters")), bound)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for edge in LENGTH_CLASSES:
        out = out + F.when(n >= edge, 1).otherwise(0)
    return out


def candidate_runs(text: Column) -> Column:
    """``array<struct<start, end, stratum, p, key>>`` of the runs that have an encoding; ``key`` is a hash of the run."""
    def judge(s, h):
        def with_encoding(x):
            alphabet = F.lit(None).cast("string")
            for name, letters in ALPHABETS.items():
                alphabet = F.when(x["enc"].isin(name, f"{name}-"), F.lit(letters)).otherwise(alphabet)
            p = F.when(x["enc"].isNotNull(), let(
                F.struct(alphabet.alias("a"), symbols(x["run"], x["enc"]).alias("r")), lambda y: random_p(y["r"], y["a"])))
            return F.struct(s.alias("start"), (s + F.length(h)).alias("end"),
                            F.concat_ws("/", x["enc"], length_class(F.length(x["run"]))).alias("stratum"),
                            p.alias("p"), F.xxhash64(x["run"]).alias("key"))
        return let(let(F.regexp_replace(h, "=+$", ""),
                       lambda r: F.struct(r.alias("run"), encoding(r).alias("enc"))), with_encoding)

    def build(x):
        return F.filter(F.zip_with(match_starts(x["p"], x["h"]), x["h"], judge), lambda z: z["p"].isNotNull())

    empty = F.array().cast("array<struct<start:bigint,end:bigint,stratum:string,p:double,key:bigint>>")
    found = let(F.struct(F.split(text, RUN, -1).alias("p"),
                         F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("h")), build)
    return F.when(text.rlike(RUN), found).otherwise(empty)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base`` (spans of the base kinds) and ``runs`` (judged runs with their p-value)."""
    text = text_or_empty(text_col)
    return docs.withColumns({"base": base_spans(text), "runs": candidate_runs(text)})


def _cut(bins: list[int], false_share: float) -> float | None:
    """Smallest p above which at most ``false_share`` of a histogram's runs are not random."""
    random_runs = 2 * sum(bins[BINS // 2:])
    for b in range(1, BINS):
        above = sum(bins[b:])
        if above and above - random_runs * (1 - b / BINS) <= false_share * above:
            return b / BINS
    return None


def cuts(scanned: DataFrame, false_share: float = FALSE_SHARE) -> dict[str, float]:
    """Smallest accepted p of each stratum, and of each dominant run (``stratum#key``); from bounded histograms."""
    runs = scanned.select(F.explode("runs").alias("r")).groupBy(
        F.col("r.stratum").alias("stratum"), F.col("r.key").alias("key"),
        F.least(F.floor(F.col("r.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    rows = runs.groupBy("stratum", "bin").agg(F.count("*").alias("runs"), F.sum("n").alias("copies"),
                                              F.max("n").alias("most")).collect()
    counts: dict[str, list[int]] = {}
    copies: dict[str, list[int]] = {}
    for r in rows:
        copies.setdefault(r["stratum"], [0] * BINS)[r["bin"]] += r["copies"]
        for name in (r["stratum"], r["stratum"].split("/")[0], ""):
            counts.setdefault(name, [0] * BINS)[r["bin"]] += r["runs"]
    out = {}
    for stratum in sorted(copies):
        bins = next((counts[name] for name in (stratum, stratum.split("/")[0], "") if sum(counts[name][1:]) >= ENOUGH),
                    None)
        cut = false_share if bins is None else _cut(bins, false_share)
        if cut is not None:
            out[stratum] = cut
    least = {k: max(ENOUGH, false_share * sum(v)) for k, v in copies.items()}
    if any(r["most"] >= least[r["stratum"]] for r in rows):
        # at most 1 / false_share runs of a stratum
        limit = F.create_map(*[F.lit(x) for k, v in sorted(least.items()) for x in (k, float(v))])
        for r in runs.where(F.col("n") >= F.try_element_at(limit, F.col("stratum"))).collect():
            cut = _cut(copies[r["stratum"]], false_share)
            out[f"{r['stratum']}#{r['key']}"] = 2.0 if cut is None else cut     # no p reaches 2
    return out


def decide(scanned: DataFrame, cut: dict[str, float]) -> DataFrame:
    """Add ``spans``: the base spans and the accepted runs, by start, then kind."""
    if cut:
        limit = F.create_map(*[F.lit(x) for kv in sorted(cut.items()) for x in kv])
        added = F.transform(F.filter("runs", lambda r: r["p"] >= F.coalesce(
            F.try_element_at(limit, F.concat_ws("#", r["stratum"], r["key"].cast("string"))),
            F.try_element_at(limit, r["stratum"]))),
                            lambda r: F.struct(r["start"], F.lit(3).alias("kind"), r["end"])).cast(SPAN)
    else:
        added = F.array().cast(SPAN)
    return scanned.withColumn("spans", F.array_sort(F.concat("base", added)))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    def build(x):
        s = x["s"]
        ends = running_maxima(F.transform(s, lambda z: z["end"]))
        parts = F.zip_with(s, ends, lambda z, e: F.when(z["start"] >= e, F.concat(
            x["t"].substr((e + 1).cast("int"), (z["start"] - e).cast("int")), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform(s, lambda z: z["end"]))
        return F.concat(F.array_join(parts, ""), x["t"].substr((last + 1).cast("int"), F.length(x["t"])))

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("t"), spans.alias("s")), build)).otherwise(text)


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    found = materialize(scan(docs).select("doc_id", "base", "runs"), "secret-spans")
    out = decide(found, cuts(found))
    return out.select("doc_id", *[_count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                      span_text(F.col("spans")).alias("spans"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets are replaced by a mark.

    The cuts come from a first pass over the stage's whole input.
    """
    names = docs.columns
    found = materialize(scan(docs).select("runs"), "secret-runs")
    out = decide(scan(docs), cuts(found))
    text = redact(text_or_empty("text"), F.col("spans"))
    return out.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))) \
        .withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                    .otherwise(F.col("n_chars"))).select(*names)
