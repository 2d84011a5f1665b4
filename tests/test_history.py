from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from garimpo.operators import history

T0 = datetime(2020, 1, 1)
SCHEMA = "k string, v double, w string, ts timestamp, id string"
DAY = history.DAY_US


def at(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


def brute(data):
    """(k, v, ts) of the version starts, by reading each key's rows in order."""
    out, keys = [], {}
    for k, v, _, ts, i in data:
        if k is not None and ts is not None:
            keys.setdefault(k, []).append((ts, i, v))
    for k, seen in keys.items():
        last = object()
        for ts, _, v in sorted(set(seen), key=lambda x: (x[0], x[1])):
            if v != last:
                out.append((k, v, ts))
            last = v
    return sorted(out, key=repr)


def sample(seed: int, n: int = 300):
    r = random.Random(seed)
    data = [("hot" if r.random() < 0.4 else f"k{r.randrange(12)}", r.choice([1.0, 2.0, None]), r.choice(["a", "b"]), at(r.randrange(900)), f"{i:04d}") for i in range(n)]
    return data + data[:40]


@pytest.mark.parametrize("bucket_us", [DAY // 24, DAY * 2, DAY * 400])
def test_changes_equal_brute_force(spark, rows, bucket_us):
    data = sample(bucket_us)
    df = spark.createDataFrame(data, SCHEMA)
    got = history.changes(df, ["k"], ["v"], "ts", ["id"], bucket_us=bucket_us)
    assert rows(got, "k", "v", "valid_from") == brute(data)


def test_null_keys_ties_and_empty(spark, rows):
    data = [(None, 1.0, "", at(0), "1"), ("a", 1.0, "", None, "2"), ("a", 1.0, "", at(1), "3"), ("a", 2.0, "", at(1), "4"), ("a", 1.0, "", at(1), "5")]
    got = history.changes(spark.createDataFrame(data, SCHEMA), ["k"], ["v"], "ts", ["id"])
    assert rows(got, "k", "v", "valid_from") == [("a", 1.0, at(1)), ("a", 1.0, at(1)), ("a", 2.0, at(1))]
    assert history.changes(spark.createDataFrame([], SCHEMA), ["k"], ["v"], "ts", ["id"]).count() == 0


def test_periods_end_where_the_next_version_starts(spark, rows):
    data = [("a", 1.0, "", at(h), str(h)) for h in (0, 5)] + [("a", 2.0, "", at(400), "400"), ("a", 1.0, "", at(900), "900")]
    sat = history.changes(spark.createDataFrame(data, SCHEMA), ["k"], ["v"], "ts", ["id"])
    got = history.periods(sat, ["k"], ["id"])
    assert rows(got, "v", "valid_from", "valid_to") == [(1.0, at(0), at(400)), (1.0, at(900), None), (2.0, at(400), at(900))]
    assert rows(history.as_of(sat, ["k"], F.lit(at(500)), ["id"]), "k", "v") == [("a", 2.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_with_late_rows_give_the_same_periods(spark, rows, seed):
    data = sample(seed, 120)
    df = spark.createDataFrame(data, SCHEMA)
    whole = history.periods(history.changes(df, ["k"], ["v"], "ts", ["id"]), ["k"], ["id"])
    old, new = df.filter(F.col("id") < "0070"), df.filter(F.col("id") >= "0070")
    sat = history.changes(old, ["k"], ["v"], "ts", ["id"])
    more = history.append(sat, new, old, ["k"], ["v"], "ts", ["id"])
    got = history.periods(sat.unionByName(more), ["k"], ["id"])
    assert rows(got, "k", "v", "valid_from", "valid_to") == rows(whole, "k", "v", "valid_from", "valid_to")


def test_change_rates_split_attributes(spark):
    data = [("a", float(i), "same", at(i), str(i)) for i in range(5)]
    df = spark.createDataFrame(data, SCHEMA)
    rates = {r.attribute: r.rate for r in history.change_rates(df, ["k"], ["v", "w"], "ts", ["id"]).collect()}
    assert rates == {"v": 1.0, "w": 0.0}
    assert history.split_by_rate(rates) == (["v"], ["w"])
    assert [r.rate for r in history.change_rates(spark.createDataFrame([], SCHEMA), ["k"], ["v"], "ts").collect()] == [None]


def test_clashing_columns_are_left_alone(spark):
    df = spark.createDataFrame([("a", 1.0, "x", at(0), "1")], SCHEMA).withColumns({"before": F.lit(1), "group": F.lit(2), "last": F.lit(3)})
    got = history.neighbours(df, ["k"], "ts", ["id"], "v", "before_v")
    assert got.columns == [*df.columns, "before_v"] and got.first().before_v is None
