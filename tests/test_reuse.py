"""Model results that outlive a run: calls are counted in files that tasks append to."""

import os
import time

import pytest
from pyspark.sql import functions as F

from ragloom.operators import embed as E
from ragloom.operators import judge as J
from ragloom.operators import reuse as RU


def _counting(folder, fail_on=None, wait=0.0):
    """A model that logs every call with its time, and fails on a marker as long as ``fail_on`` exists."""
    os.makedirs(folder, exist_ok=True)

    class Counting:
        def _log(self, items):
            began = time.time()
            time.sleep(wait)
            if fail_on and os.path.exists(fail_on) and any("MARK" in str(x) for x in items):
                raise RuntimeError("model is gone")
            with open(f"{folder}/{os.getpid()}-{time.time_ns()}-{id(items)}", "w") as fh:
                fh.write(f"{began} {time.time()} {len(items)}")

        def __call__(self, items):
            self._log(items)
            return [[float(len(t)), 1.0] for t in items]

    class Answers(Counting):
        def __call__(self, items):
            self._log(items)
            return [f"answer to {t}" for t in items]

    class Judge(Counting):
        def __call__(self, items):
            self._log(items)
            return [{"faithfulness": [1, 0], "context_recall": []} for _ in items]
    return Counting(), Answers(), Judge()


def _calls(folder):
    out = []
    for f in os.listdir(folder):
        with open(f"{folder}/{f}") as fh:
            a, b, n = fh.read().split()
            out.append((float(a), float(b), int(n)))
    return out


def _asked(folder):
    return sum(n for _, _, n in _calls(folder))


def test_second_run_makes_no_model_call(spark, tmp_dir):
    model, _, _ = _counting(f"{tmp_dir}/calls")
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "i int, t string")
    want = {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None, 5: [0.0, 1.0]}
    for _ in range(2):
        out = RU.embed_cached(df, "t", "v", f"{tmp_dir}/cache", embedder=model, name="m1")
        assert out.columns == ["i", "t", "v"]
        assert {r["i"]: r["v"] for r in out.collect()} == want
        assert _asked(f"{tmp_dir}/calls") == 3
    more = df.unionByName(spark.createDataFrame([(6, "ccc")], df.schema))
    assert RU.embed_cached(more, "t", "v", f"{tmp_dir}/cache", embedder=model, name="m1").count() == 6
    assert _asked(f"{tmp_dir}/calls") == 4
    RU.embed_cached(df, "t", "v", f"{tmp_dir}/cache", embedder=model, name="other model").count()
    assert _asked(f"{tmp_dir}/calls") == 7
    assert RU.embed_cached(df.limit(0), "t", "v", f"{tmp_dir}/cache", embedder=model, name="m1").count() == 0


def test_a_run_that_ended_early_goes_on(spark, tmp_dir):
    """A job is killed by its model in one slice; the slices before it are not asked for again."""
    broken = f"{tmp_dir}/broken"
    open(broken, "w").close()
    df = spark.createDataFrame([(i, f"text {i}" + (" MARK" if i == 37 else "")) for i in range(200)], "i int, t string")
    model, _, _ = _counting(f"{tmp_dir}/calls", fail_on=broken)

    def run():
        return RU.embed_cached(df, "t", "v", f"{tmp_dir}/cache", embedder=model, name="m", slice_rows=40, retries=1)

    with pytest.raises(Exception, match="model is gone"):
        run()
    kept = spark.read.parquet(f"{tmp_dir}/cache").count() if os.path.exists(f"{tmp_dir}/cache") else 0
    os.remove(broken)
    before = _asked(f"{tmp_dir}/calls")
    assert run().where("v is null").count() == 0
    assert _asked(f"{tmp_dir}/calls") - before == 200 - kept
    assert spark.read.parquet(f"{tmp_dir}/cache").count() == 200


def test_failed_answers_are_asked_again(spark, tmp_dir):
    broken = f"{tmp_dir}/broken"
    open(broken, "w").close()
    _, model, _ = _counting(f"{tmp_dir}/calls", fail_on=broken)
    df = spark.createDataFrame([(1, "p1"), (2, "p2 MARK"), (3, None), (4, "p1")], "i int, prompt string")

    def run(**kw):
        return {r["i"]: (r["answer"], r["error"]) for r in RU.generate_resumable(
            df, f"{tmp_dir}/answers", generator=model, name="g", batch_size=1, **kw).collect()}

    first = run()
    assert first[1] == first[4] == ("answer to p1", None) and first[2][1] == "model is gone" and first[3] == (None, None)
    assert run(retry_errors=False) == first
    os.remove(broken)
    assert run()[2] == ("answer to p2 MARK", None) and run()[1] == first[1]
    assert _asked(f"{tmp_dir}/calls") == 2


def test_judged_records_are_kept(spark, tmp_dir):
    _, _, judge = _counting(f"{tmp_dir}/calls")
    rec = spark.createDataFrame([(1, "q", "a", "r", ["c"]), (2, "q", "a", "r", ["c"]), (3, "q2", "a", None, [])],
                                "qid int, question string, answer string, reference string, contexts array<string>")
    want = sorted(map(tuple, J.judge_records(rec, judge).collect()))
    for _ in range(2):
        got = RU.judge_resumable(rec, f"{tmp_dir}/verdicts", judge=judge, name="j")
        assert sorted(map(tuple, got.collect())) == want and got.columns == ["qid", "kind", "pos", "verdict", "error"]
    assert _asked(f"{tmp_dir}/calls") == 3 + 2                          # without the table, then each record once


@pytest.mark.parametrize("budget,per_task", [(3, 1), (4, 2)])
def test_calls_at_once_stay_within_the_budget(spark, tmp_dir, budget, per_task):
    model, _, _ = _counting(f"{tmp_dir}/calls", wait=0.05)
    df = spark.range(0, 96, 1, 12).select("id", F.concat(F.lit("t"), "id").alias("t"))
    out = E.embed(df, "t", "v", embedder=model, batch_size=2, max_concurrency=budget, calls_per_task=per_task)
    from conftest import plan_text
    assert "Exchange" not in plan_text(out)                             # rows stay in place
    assert {r["id"]: r["v"][0] for r in out.collect()} == {i: float(len(f"t{i}")) for i in range(96)}
    calls = _calls(f"{tmp_dir}/calls")
    at_once = max(sum(a <= t < b for a, b, _ in calls) for t, _, _ in calls)
    assert len(calls) == 48 and 1 < at_once <= budget


def test_bad_budgets(spark):
    with pytest.raises(ValueError):
        E.within_budget(spark.range(3), 2, 3)
