from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from garimpo.operators import skew
from garimpo.session import cut, drop_cuts


def test_lookup_of_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    data = [("hot", i) for i in range(40)] + [(f"k{i}", i) for i in range(10)] + [(None, 99)]
    df = spark.createDataFrame(data, "k string, n int")
    table = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("other", "x")], "k string, v string")
    hot = skew.hot_keys(df, "k")
    assert [r.k for r in hot] == ["hot"]
    got = skew.lookup(df, "k", table, "v", hot)
    assert rows(got) == rows(skew.lookup(df, "k", table, "v", [])) and got.count() == 51
    assert got.filter("v = 'H'").count() == 40 and got.filter("k IS NULL AND v IS NULL").count() == 1
    assert skew.hot_keys(df.limit(0), "k") == []


def test_cut_keeps_rows_and_types(spark):
    df = spark.range(5).withColumn("a", F.array(F.struct(F.col("id").alias("x")))).filter("id < 3")
    got = cut(df)
    assert got.dtypes == df.dtypes and got.count() == 3 and cut(df.limit(0)).count() == 0
    assert drop_cuts(spark) >= 2 and drop_cuts(spark) == 0
    assert not [f for f in got.inputFiles() if Path(f.removeprefix("file://")).exists()]
