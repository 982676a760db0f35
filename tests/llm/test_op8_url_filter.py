"""URL filter: SQL, exact cascade, both ways of the list, odd urls."""

import duckdb
from pyspark.sql import functions as F

from conftest import SF_MID
from ragloom.llm import op8_url_filter as U


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF_MID}/pages.parquet')")
    got = sorted(map(tuple, U.op8_url_filter(spark, SF_MID).collect()), key=str)
    assert got == sorted(con.execute(U.SQL).fetchall(), key=str)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = spark.range(0, 20_000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = U.build_cascade(listed, universe)
    assert len(cascade.levels) >= 2
    wrong = universe.withColumn("want", F.substring("key", 2, 20).cast("int") % 7 == 0) \
        .where(F.col("want") != cascade.contains(F.col("key")))
    assert wrong.count() == 0


def test_odd_urls_and_both_ways_of_the_list(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1?x#y", "x://h?q://z/p", "a\nb://spam-farm.example.org/q\nr",
            "http://example.org/es/1", "http://notexample.org/es/1", "http://org", "http://org/", "http://x.com/fr/", "http://x.com/de",
            "http://x.com/de/", "http://É.com/fr/a", "http://adult-x.example.com/en/5", "http://adult-x.example.com/de/5"]
    df = spark.createDataFrame([(i, u, "clash", 7) for i, u in enumerate(urls + urls)],
                               "page_id int, url string, rule string, extra int")
    listed = U.labelled_keys(df)
    one = U.judge(df, listed)
    two = U.judge(df, listed, max_bits=1)
    key = ["page_id", "host", "path", "rule", "verdict", "extra"]
    got = sorted(map(tuple, one.select(key).collect()))
    assert got == sorted(map(tuple, two.select(key).collect()))
    by = {r[0]: r[1:5] for r in got}
    assert by[0] == by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert by[5] == ("h", "", None, "allow")
    assert by[6] == ("spam-farm.example.org", "/q\nr", "org/", "allow")
    assert by[7][2:] == ("example.org/es/", "block") and by[8][2:] == ("org/", "allow")
    assert by[9][2] is None and by[10][2] == "org/" and by[12][2:] == (None, "allow")
    assert by[14][0] == "É.com" and by[14][2] == "com/fr/"
    assert by[15][2:] == (None, "block") and by[16][2:] == ("com/de/", "block")


def test_empty_lists_and_tables(spark):
    df = spark.createDataFrame([(1, "http://x.net/a")], "page_id int, url string")
    assert U.judge(df, U.labelled_keys(df)).first()["verdict"] == "allow"
    assert U.judge(df.limit(0), U.labelled_keys(df)).count() == 0
