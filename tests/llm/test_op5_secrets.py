"""Secret scans against a brute-force scan with Python's regular expressions."""

import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from conftest import SF_MID
from ragloom.llm import op5_secrets as S

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
                    r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(rows):
    for r in rows:
        want = brute(r["text"])
        assert [tuple(s) for s in r["base"]] == want, r["text"]


def test_base_spans_of_planted_texts(spark):
    hexrun = "0123456789abcdef0123456789"
    texts = [None, "", "no secret", 'é😀 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end',
             "secret=token = abcdefgh", "PASSWORD:'abc' Api_Key=abcdefg apikey:  \"zz/+zz\"", "AKIA" + "A" * 16,
             "AKIA" + "B" * 15 + " AKIA" + "7" * 40, hexrun * 3 + "g" + hexrun, "token=" + hexrun + " " + hexrun,
             "x token=ſecret=aaaaaa ſecret=bbbbbb", "passwd = a.b=c-d " * 300, "é" * 5000 + "secret: hunter22",
             "password= password=abcdef", "toKen:\tabcdefg", 'api_key"  :   "abcdef']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id int, text string")
    check(S.scan(df).collect())


def test_random_mixtures(spark):
    rnd = random.Random(5)
    parts = ["token", "=", " ", "'", "secret", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "é", ":", "passwd", "x", ".",
             "apikey", "API_KEY", '"', "zzz", "\n", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    check(S.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect())


def test_query_matches_brute_force(spark):
    rows = {r["doc_id"]: r for r in S.op5_secrets(spark, SF_MID).collect()}
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want, got = brute(d["text"]), rows[d["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        spans = [s for s in got["spans"].split(",") if s and not s.startswith("random")]
        assert spans == [s for s in joined(want).split(",") if s]


def test_battery_accepts_random_runs_and_rejects_words(spark):
    rnd = random.Random(1)
    b64 = S.ALPHABETS["base64"]
    rows = [(f"key {''.join(rnd.choice(b64[:62]) for _ in range(40))} end", 1) for _ in range(300)]
    rows += [(f"see {'AbcAbcAbd1' * 4} and {'Thequickbrownfoxjumps2overthelazydogs'}", 0) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, truth int")
    scanned = S.scan(df)
    out = S.decide(scanned, S.cuts(scanned)).withColumn("n", F.size("spans")).groupBy("truth").agg(
        F.avg((F.col("n") > 0).cast("double")).alias("share")).collect()
    share = {r["truth"]: r["share"] for r in out}
    assert share[1] > 0.7 and share[0] < 0.05


def test_p_values_are_uniform_for_random_runs(spark):
    rnd = random.Random(2)
    rows = [("".join(rnd.choice("0123456789abcdef") for _ in range(64)),) for _ in range(2000)]
    p = [r["p"] for r in S.scan(spark.createDataFrame(rows, "text string"))
         .select(F.explode("runs.p").alias("p")).collect()]
    assert 0.4 < sum(p) / len(p) < 0.6
    assert 0.15 < sum(x < 0.25 for x in p) / len(p) < 0.35


def test_redaction_and_defined_cases(spark):
    df = spark.createDataFrame([("a token=abcdefgh é secret: zzzzzzz!", 1), (None, 2), ("", 3), ("clean", 4)],
                               "text string, spans int")
    scanned = S.scan(df)
    out = S.decide(scanned, {})
    red = {r["base_n"]: r["t"] for r in out.select(
        S.redact(S.text_or_empty("text"), F.col("spans")).alias("t"), F.size("base").alias("base_n")).collect()}
    assert red[2] == "a [SECRET] é [SECRET]!"
    empty = S.scan(df.limit(0))
    assert S.cuts(empty) == {} and S.decide(empty, {}).count() == 0


def brute_p(run, alphabet):
    """The battery, step by step."""
    x = [alphabet.index(c) for c in run.translate(str.maketrans("-_", "+/")) if c in alphabet]
    n, size = len(x), len(alphabet)

    def tail(z):
        return math.erfc(z / math.sqrt(2)) / 2

    chi = sum(x.count(i) ** 2 for i in set(x)) * size / n - n
    df = size - 1
    uniform = tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / 9 / df)) / math.sqrt(2 / 9 / df))
    side = [c * 2 >= size for c in x]
    high = sum(side)
    runs = 1 + sum(a != b for a, b in zip(side, side[1:], strict=False))
    mean = 1 + 2 * high * (n - high) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    run_test = min(1.0, 2 * tail(abs(runs - mean) / math.sqrt(var))) if var > 0 else 0.0
    mid = sum(x) / n
    spread = sum((c - mid) ** 2 for c in x)
    lagged = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:], strict=False))
    serial = min(1.0, 2 * tail(abs((lagged / spread + 1 / n) * math.sqrt(n)))) if spread > 0 else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, run_test, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def test_p_values_equal_the_brute_ones(spark):
    rnd = random.Random(10)
    runs = []
    for name, letters in S.ALPHABETS.items():
        for size in (20, 24, 33, 64, 300):
            for pool in (letters, letters[:7], letters[::3]):
                runs.append((name, "".join(rnd.choice(pool) for _ in range(size))))
    df = spark.createDataFrame(runs, "name string, run string")
    alphabet = F.lit(None).cast("string")
    for name, letters in S.ALPHABETS.items():
        alphabet = F.when(F.col("name") == name, F.lit(letters)).otherwise(alphabet)
    for r in df.withColumn("p", S.random_p(F.col("run"), alphabet)).collect():
        assert abs(r["p"] - brute_p(r["run"], S.ALPHABETS[r["name"]])) < 2e-5, r


def brute_cut(p, share):
    """The smallest cut, from the p-values themselves."""
    bins = [0] * S.BINS
    for x in p:
        bins[min(int(x * S.BINS), S.BINS - 1)] += 1
    null = 2 * sum(1 for x in p if x >= 0.5)
    for b in range(1, S.BINS):
        above = [x for x in p if x >= b / S.BINS]
        if above and len(above) - null * (1 - b / S.BINS) <= share * len(above):
            return b / S.BINS
    return None


def test_cuts_equal_the_brute_ones(spark):
    rnd = random.Random(11)
    keys = _keys(rnd, 300) + [(w * 9)[:40] for w in {"".join(rnd.choice("abcDEF123") for _ in range(7)) for _ in range(200)}]
    df = spark.createDataFrame([(k,) for k in keys], "text string")
    scanned = S.scan(df)
    by = {}
    for r in scanned.select("text", F.explode("runs").alias("r")).collect():
        by.setdefault(r["r"]["stratum"], {})[r["text"]] = r["r"]["p"]
    got = S.cuts(scanned)
    large = {k: list(v.values()) for k, v in by.items() if sum(x >= 1 / S.BINS for x in v.values()) >= S.ENOUGH}
    assert large
    for stratum, p in large.items():
        assert got.get(stratum) == brute_cut(p, S.FALSE_SHARE)


def test_very_long_runs_are_linear(spark):
    rnd = random.Random(12)
    letters = S.ALPHABETS["base64"]
    long = "".join(rnd.choices(letters, k=1_000_000))
    df = spark.createDataFrame([(1, "img " + long + " end"), (2, long[:6000]), (3, "a" * 300_000), (4, "token=abcdef " * 20_000)],
                               "doc_id long, text string")
    began = time.time()
    scanned = S.scan(df)
    rows = {r["doc_id"]: r for r in S.decide(scanned, {"base64/5": 0.01}).select(
        "doc_id", "runs", "spans", F.length(S.redact(F.col("text"), F.col("spans"))).alias("n")).collect()}
    assert time.time() - began < 60
    assert [(r["start"], r["end"]) for r in rows[1]["runs"]] == [(4, 1_000_004)] and rows[1]["runs"][0]["p"] > 0.01
    assert len(rows[2]["runs"]) == 1 and rows[3]["runs"] == []
    assert len(rows[4]["spans"]) == 20_000 and rows[4]["n"] == 20_000 * 9


def _keys(rnd, n, size=40):
    return ["".join(rnd.choice(S.ALPHABETS["base64"][:62]) for _ in range(size)) for _ in range(n)]


def _p_of(spark, runs):
    rows = S.scan(spark.createDataFrame([(r,) for r in runs], "text string")).select("text", "runs").collect()
    return {r["text"]: r["runs"][0]["p"] for r in rows if r["runs"]}


def test_copies_of_one_run_dont_move_the_cut(spark):
    keys = _keys(random.Random(4), 600)
    p = _p_of(spark, keys)
    hot = min(p, key=lambda k: abs(p[k] - 0.3))
    df = spark.createDataFrame([(k,) for k in keys], "text string")
    copies = df.unionByName(spark.range(3000).select(F.lit(hot).alias("text")))
    got = S.cuts(S.scan(copies))
    assert {k: v for k, v in got.items() if "#" not in k} == S.cuts(S.scan(df))


def test_lone_key_of_its_length_is_found(spark):
    rnd = random.Random(6)
    p = _p_of(spark, _keys(rnd, 40, 90))
    lone = next(k for k in sorted(p) if 0.2 < p[k] < 0.45)
    for others in (_keys(rnd, 300), []):
        scanned = S.scan(spark.createDataFrame([(k,) for k in [lone, *others]], "text string"))
        found = S.decide(scanned, S.cuts(scanned)).where(F.col("text") == lone).first()
        assert [(r["start"], r["kind"], r["end"]) for r in found["spans"]] == [(0, 3, 90)]


def test_keys_of_every_case_and_separator_have_an_encoding(spark):
    want = {"9233A8ECF7C5B09FE5949719B6B82BC439E9329B": "hex", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff": "hex",
            "K8X1Q0ZP3M9TW7B2VJ5R": "base36", "k8x1q0zp3m9tw7b2vj5r": "base36", "K3XAQ2ZP3M5TW7B2VJ5R": "base32",
            "123e4567-e89b-12d3-a456-426614174000": "hex-", "sk_live_k8x1q0zp3m9tw7b2vj5r": "base36-",
            "AB_K8X1Q0ZP3M9TW7B2VJ5R": "base36-", "QmzXvPbKwTqLdRyHsNcF": "mixed", "aB3-xY7_kL9mN2pQ5rS8": "base64",
            "internationalization": None, "12345678901234567890": None, "--------------------": None,
            "one-word-after-another": None}
    df = spark.createDataFrame([(k,) for k in want], "text string")
    rows = S.scan(df.withColumn("enc", S.encoding(F.col("text")))).select("text", "enc", "runs").collect()
    assert {r["text"]: r["enc"] for r in rows} == want
    assert all(len(r["runs"]) == (r["enc"] is not None) for r in rows)
    by = {r["text"]: r["runs"] for r in rows}
    assert by["9233A8ECF7C5B09FE5949719B6B82BC439E9329B"][0]["p"] > 0.01
    assert by["K8X1Q0ZP3M9TW7B2VJ5R"][0]["p"] == by["k8x1q0zp3m9tw7b2vj5r"][0]["p"]
