"""Runs by model: grid of records, failing generators, bootstrap intervals."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as SE
from conftest import SF_SMALL, plan_text
from ragloom.functions import prompts as P
from ragloom.operators import model_runs as MR
from ragloom.operators import topk as K


def _prefix(marker=None):
    class Prefix:
        """Answers with the start of the prompt; fails on prompts that hold a marker."""

        def __call__(self, prompts):
            if marker and any(marker in p for p in prompts):
                raise RuntimeError("no answer")
            return [p[:12] for p in prompts]
    return Prefix()


@pytest.fixture(scope="module")
def asked(spark):
    corpus, q = SE._qa(spark, SF_SMALL)
    return q, K.top_k(corpus, q, 3, exclude_col="self_id", payload=["input", "output"])


def test_grid_has_every_run_of_every_model(spark, asked):
    q, hits = asked
    n = q.count()
    models = [*MR.STAND_INS, MR.Model("prefix", generator=_prefix())]
    rec = MR.grid_records(q, hits, models, ks=(1, 3))
    runs = {r["run_id"]: (r["model"], r["k"], r["n"]) for r in
            rec.groupBy("run_id", "model", "k").agg(F.count("*").alias("n")).collect()}
    assert runs == {f"{m.name}/{run}": (m.name, k, n) for m in models for run, k in (("baseline", 0), ("k=1", 1), ("k=3", 3))}
    sizes = rec.groupBy("k").agg(F.max(F.size("contexts")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in sizes} == {0: 0, 1: 1, 3: 3}
    assert rec.where((F.col("k") == 0) & (F.col("model") == "full")).select("answer").distinct().first()[0] == P.REFUSAL
    assert rec.where("model = 'prefix' and answer <> substring(prompt, 1, 12)").count() == 0


def test_failed_answers_have_no_metrics(spark, asked):
    q, hits = asked
    first = q.orderBy("qid").first()
    rec = MR.grid_records(q, hits, [MR.Model("prefix", generator=_prefix(first["question"]), batch_size=1)], ks=(1,))
    scores = MR.grid_scores(rec)
    failed = scores.where(F.col("answer_similarity").isNull()).select("qid", "run_id").collect()
    assert {(r["qid"], r["run_id"]) for r in failed} >= {(first["qid"], "prefix/k=1"), (first["qid"], "prefix/baseline")}
    assert scores.count() == 2 * q.count()


def test_bootstrap_against_a_plain_one(spark):
    rnd = random.Random(3)
    rows = [(run, f"q{i}", None if run == "b" and i % 10 == 0 else rnd.gauss(mean, 1.0))
            for run, mean in (("a", 0.0), ("b", 0.4), ("c", 0.0)) for i in range(300)]
    df = spark.createDataFrame(rows, "run_id string, qid string, m double")
    got = {r["run_id"]: r for r in MR.paired_bootstrap(df, "a", metrics=("m",), replicates=400).collect()}
    by = {(run, q): v for run, q, v in rows}
    for run in ("b", "c"):
        d = [by[run, f"q{i}"] - by["a", f"q{i}"] for i in range(300) if by[run, f"q{i}"] is not None]
        r = got[run]
        assert r["questions"] == len(d) and r["delta"] == pytest.approx(sum(d) / len(d), abs=1e-6)
        means = sorted(sum(rnd.choices(d, k=len(d))) / len(d) for _ in range(2000))
        assert r["low"] == pytest.approx(means[50], abs=0.05) and r["high"] == pytest.approx(means[1950], abs=0.05)
        assert r["low"] < r["delta"] < r["high"]
    assert got["b"]["low"] > 0
    assert MR.paired_bootstrap(df, "no such run", metrics=("m",)).count() == 0


def test_weights_are_poisson(spark):
    w = [x for r in spark.range(200).select(MR.weights(F.col("id"), 100).alias("w")).collect() for x in r["w"]]
    assert sum(w) / len(w) == pytest.approx(1.0, abs=0.03)
    assert sum(x == 0 for x in w) / len(w) == pytest.approx(0.3679, abs=0.02)


def test_bootstrap_draws_each_question_once(spark):
    """Against sums over the weights; repeated keys count per row, null keys and values not at all."""
    rnd = random.Random(5)
    rows = [(run, key, rnd.random() if i % 7 else None, rnd.random())
            for run in ("a", "b", "c") for i, key in enumerate([*range(40), 3, 3, 9, None])]
    df = spark.createDataFrame(rows, "run_id string, qid int, m double, x double")
    w = {r["qid"]: r["w"] for r in df.select("qid", MR.weights(F.col("qid"), 30).alias("w")).distinct().collect()}
    got = {(r["run_id"], r["metric"]): r for r in MR.paired_bootstrap(df, "a", metrics=("m", "x"), replicates=30,
                                                                     interval=(0.0, 1.0)).collect()}
    assert len(got) == 4
    for (run, metric), r in got.items():
        at = 2 + (metric == "x")
        pairs = [(p[1], p[at], q[at]) for p in rows for q in rows if p[0] == run and q[0] == "a" and p[1] is not None
                 and p[1] == q[1] and p[at] is not None and q[at] is not None]
        deltas = [sum(w[k][b] * (v - u) for k, v, u in pairs) / sum(w[k][b] for k, _, _ in pairs) for b in range(30)]
        assert r["questions"] == len(pairs) and r["mean_base"] == pytest.approx(sum(u for *_, u in pairs) / len(pairs), abs=1e-6)
        assert (r["low"], r["high"]) == pytest.approx((min(deltas), max(deltas)), abs=1e-6)


def test_bootstrap_makes_no_row_per_replicate(spark, monkeypatch):
    """A thousand replicates multiply no question: only the tasks' sums leave the product of the matrices."""
    sent = []
    checkpoint = MR.cut_lineage
    monkeypatch.setattr(MR, "cut_lineage", lambda df: sent.append(df.columns) or checkpoint(df))
    df = spark.range(2000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run_id"), F.col("id").alias("qid"),
                                  F.rand(1).alias("m"))
    out = MR.paired_bootstrap(df, "a", metrics=("m",), replicates=50)
    plan = plan_text(out)
    assert "MapInArrow" in plan and "posexplode" not in plan
    assert ["run_id", "qid", "m"] in sent and out.count() == 1
