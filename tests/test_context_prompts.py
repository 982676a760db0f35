"""Contexts, prompt filling, messages, routing and refusal flag."""

from pyspark.sql import functions as F

from ragloom.functions import prompts as P
from ragloom.functions import text as TX
from ragloom.functions import vectors as V
from ragloom.operators import context as CX


def _hits(spark):
    rows = [(1, 2, "q_2", 0.5, "둘", "B"), (1, 1, "q_1", 0.91234, "하나", "A"), (1, 3, "q_3", 0.125, None, "C"),
            (2, 1, "q_9", 0.3, "x", "Z")]
    return spark.createDataFrame(rows, "qid int, rk int, id string, score double, input string, output string")


def test_contexts_follow_rank(spark):
    got = {r.qid: r.contexts for r in CX.contexts(_hits(spark)).collect()}
    assert got == {1: ["A", "B", "C"], 2: ["Z"]}
    joined = CX.contexts(_hits(spark)).select("qid", CX.join_contexts("contexts").alias("c"))
    assert {r.qid: r.c for r in joined.collect()}[1] == "A\n\n---\n\nB\n\n---\n\nC"


def test_scored_reference_keeps_korean_and_arrow(spark):
    got = {r.qid: r.reference_block for r in CX.scored_reference(_hits(spark)).collect()}
    assert got[1].split("\n\n")[0] == "[0.9123] 하나 → A"
    assert got[2] == "[0.3000] x → Z"


def test_numbered_documents_missing_fields_are_empty(spark):
    got = {r.qid: r.documents for r in CX.numbered_documents(_hits(spark)).collect()}
    assert got[1].endswith("Document 3:\nInput: \nOutput: C")
    assert got[1].startswith("Document 1:\nInput: 하나\nOutput: A\n\nDocument 2:")


def test_braces_in_values_are_not_filled_again(spark):
    df = spark.createDataFrame([("{reference}", "{question}")], "q string, r string")
    out = df.select(P.reference_prompt("q", "r").alias("p")).first().p
    assert out == P.REFERENCE_TEMPLATE.replace("{question}", "\0").replace("{reference}", "{question}") \
        .replace("\0", "{reference}")
    assert P.template_parts("a{x}b{y}") == [("lit", "a"), ("slot", "x"), ("lit", "b"), ("slot", "y")]


def test_baseline_and_context_prompts(spark):
    df = spark.createDataFrame([("질문", None)], "q string, c string")
    r = df.select(P.baseline_prompt("q").alias("b"), P.context_prompt("c", "q").alias("c")).first()
    assert r.b.endswith("#Question:\n질문\n\n#Answer:") and P.REFUSAL in r.b
    assert "#Context:\n\n\n#Question:\n질문" in r.c


def test_chat_messages_have_system_then_user(spark):
    df = spark.createDataFrame([("docs", "q?")], "d string, q string")
    m = df.select(P.chat_messages("d", "q").alias("m")).first().m
    assert [x.role for x in m] == ["system", "user"]
    assert m[0].content == P.SYSTEM_MESSAGE and "참고 문서:\ndocs" in m[1].content


def test_route_prefers_given_documents(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    given = spark.createDataFrame([(1, "G"), (2, "")], "qid int, documents string")
    ret = spark.createDataFrame([(1, "R1"), (2, "R2")], "qid int, contexts string")
    got = {r.qid: (r.source, r.context) for r in CX.route(q, given, ret).collect()}
    assert got == {1: ("given", "G"), 2: ("retrieved", "R2"), 3: ("none", None)}


def test_refusal_flag_and_has_documents(spark):
    df = spark.createDataFrame([(P.REFUSAL + ".", []), ("ok", ["d"]), (None, None)],
                               "a string, d array<string>")
    got = df.select(P.refusal_flag("a").alias("f"), CX.has_documents("d").alias("h")).collect()
    assert [(r.f, r.h) for r in got] == [(True, False), (False, True), (False, False)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("Hello, World! Ça va?\nOui...  ", "가나 다")], "t string, k string")
    r = df.select(TX.tokens("t").alias("tok"), TX.statements("t").alias("st"), TX.tokens("k").alias("kt"),
                  TX.format_score(F.lit(0.12345678)).alias("f")).first()
    assert r.tok == ["hello", "world", "ça", "va", "oui"]
    assert r.st == ["Hello, World", "Ça va", "Oui"]
    assert r.kt == ["가나", "다"]
    assert r.f == "0.1235"


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])],
                               "a array<float>, b array<float>")
    rows = df.select(V.l2_norm("a").alias("n"), V.cosine_similarity("a", "b").alias("c"),
                     V.cosine_distance("a", "b").alias("d"), V.l2_normalise("a").alias("u"),
                     V.from_text(V.to_text("a")).alias("rt")).collect()
    assert rows[0].n == 5.0 and rows[0].c == 1.0 and rows[0].d == 0.0 and rows[0].u == [0.6, 0.8]
    assert rows[1].c is None and rows[1].u is None
    assert rows[2].c == -1.0 and rows[2].d == 2.0
    assert all(list(r.rt) == list(x) for r, x in zip(rows, [[3.0, 4.0], [0.0, 0.0], [1.0, 0.0]]))
