"""JSON arrays and quoted CSV by byte ranges: several tasks a file, any cut."""

import csv
import json
import random

import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.sources import files as FS
from ragloom.sources import splitting as SP

NASTY = ['plain', '{', '}', '"', '\\', '\\"', '}{][', 'a "quoted} {text\\" ]', 'x\ny', 'é漢🙂}', '', ', [ {', '\\\\"}', "}" * 30]


@pytest.fixture()
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")
    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _items(n, rnd):
    return [{"input": rnd.choice(NASTY) + str(i), "output": rnd.choice([*NASTY, None]), "casename": rnd.choice(NASTY)}
            for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_in_several_tasks(spark, tmp_dir, small_ranges, indent):
    rnd = random.Random(indent or 1)
    items = _items(150, rnd)
    with open(f"{tmp_dir}/a.json", "w", encoding="utf-8") as fh:
        json.dump(items, fh, ensure_ascii=rnd.random() < 0.5, indent=indent)
    want = sorted((i["input"], i["output"] or "") for i in items)
    for size in (499, 1 << 20):
        small_ranges(size)
        df = FS.read_raw_corpus(spark, f"{tmp_dir}/a.json", split=True)
        assert sorted(map(tuple, df.collect())) == want
        tasks = SP._pieces(spark, f"{tmp_dir}/a.json", "}").rdd.getNumPartitions()
        assert tasks > 1 if size < 6000 else tasks == 1


def test_vectors_nesting_and_several_files(spark, tmp_dir, small_ranges):
    rows = [{"id": f"q_{i}", "input": "}" * (i % 4), "output": "o", "embedding": [i / 4, -1.5e-3, 2.0] * 20} for i in range(60)]
    for part in range(3):
        with open(f"{tmp_dir}/{part}.json", "w") as fh:
            fh.write("﻿" if part == 2 else "")
            json.dump(rows[part * 20:part * 20 + 20], fh)
    with open(f"{tmp_dir}/empty.json", "w") as fh:
        fh.write(" []\n")
    small_ranges(700)
    got = {r["id"]: r for r in FS.read_embedded_corpus(spark, tmp_dir, split=True).collect()}
    assert len(got) == 60
    for r in rows:
        assert got[r["id"]]["input"] == r["input"] and len(got[r["id"]]["embedding"]) == 60


def test_what_is_no_whole_array_raises(spark, tmp_dir, small_ranges):
    small_ranges(50)
    whole = json.dumps([{"input": f"text {i}", "output": "o"} for i in range(8)])
    for i, text in enumerate((whole[:-1], whole[:200], whole[:-3] + '}]', whole[1:], '{"input": "a"}')):
        with open(f"{tmp_dir}/bad{i}.json", "w") as fh:
            fh.write(text)
        with pytest.raises((ValueError, PySparkException, Py4JJavaError)):
            FS.read_raw_corpus(spark, f"{tmp_dir}/bad{i}.json", split=True).collect()
    with open(f"{tmp_dir}/broken.json", "w") as fh:
        fh.write('[{"input": "a", "output": 1 2}]')
    with pytest.raises((PySparkException, Py4JJavaError)):
        FS.read_raw_corpus(spark, f"{tmp_dir}/broken.json", split=True).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_newlines_on_range_borders(spark, tmp_dir, small_ranges, end):
    rnd = random.Random(5)
    fields = ["plain", 'a "b" c', "line\nbreak", "x\n\n\ny", ",", '"', "é漢🙂", "long " * 20, "\n", '",\n"']
    rows = [tuple(rnd.choice(fields) + str(i) for _ in range(3)) for i in range(80)]
    with open(f"{tmp_dir}/s.csv", "w", encoding="utf-8-sig", newline="") as fh:
        w = csv.writer(fh, lineterminator=end)
        w.writerow(["user_input", "response", "reference"])
        w.writerows(rows)
    whole = sorted(map(tuple, FS.read_answer_sheet(spark, f"{tmp_dir}/s.csv").collect()))
    assert whole == sorted(rows)
    for size in (4096, 171):
        small_ranges(size)
        assert sorted(map(tuple, FS.read_answer_sheet(spark, f"{tmp_dir}/s.csv", split=True).collect())) == whole
    assert SP._pieces(spark, f"{tmp_dir}/s.csv", "\n").rdd.getNumPartitions() > 2


def test_empty_fields_are_null_and_open_quotes_raise(spark, tmp_dir):
    with open(f"{tmp_dir}/s.csv", "w") as fh:
        fh.write('user_input,response,reference\na,,"c"\n')
    assert [tuple(r) for r in FS.read_answer_sheet(spark, f"{tmp_dir}/s.csv", split=True).collect()] == [("a", None, "c")]
    with open(f"{tmp_dir}/t.csv", "w") as fh:
        fh.write('user_input,response,reference\na,"b,c\n')
    with pytest.raises(ValueError):
        FS.read_answer_sheet(spark, f"{tmp_dir}/t.csv", split=True)


def test_array_writer(spark, tmp_dir):
    rows = [(n, None if i % 3 == 0 else n) for i, n in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "input string, output string")
    SP.write_json_array(df, f"{tmp_dir}/w")
    got = FS.read_raw_corpus(spark, f"{tmp_dir}/w", split=True).collect()
    assert sorted(map(tuple, got)) == sorted((a, b or "") for a, b in rows)
    SP.write_json_array(df.limit(0), f"{tmp_dir}/none")
    assert FS.read_raw_corpus(spark, f"{tmp_dir}/none", split=True).count() == 0


def test_array_rows_are_made_before_the_one_task_that_writes(spark, tmp_dir):
    """The join behind the rows runs in tasks of its own: the writing task holds no part of it."""
    import pyspark
    rows = spark.range(0, 400, 1, 8).repartition(5, "id").select("id", F.lit("{").alias("t"))

    def seen(batches):
        for batch in batches:
            yield batch.append_column("p", pa.array([pyspark.TaskContext.get().partitionId()] * batch.num_rows, pa.int32()))

    SP.write_json_array(rows.mapInArrow(seen, "id long, t string, p int"), tmp_dir + "/one")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.IntegerType())])
    got = SP.read_json_array(spark, tmp_dir + "/one", schema).collect()
    tasks = {r["p"] for r in got}
    assert sorted(r["id"] for r in got) == list(range(400)) and len(tasks) == 5
