from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from garimpo.llm import components
from garimpo.operators import skew


def brute(edges):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in parent)


def graph(seed):
    r = random.Random(seed)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i:03d}") for i in range(80)]
    mess = [(f"m{r.randrange(50)}", f"m{r.randrange(50)}") for _ in range(35)]
    edges = chain + star + mess + [("x", "x"), (None, "a"), ("b", None), ("c001", "c000"), ("c000", "c001")]
    r.shuffle(edges)
    return edges


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 3])
def test_groups_equal_union_find(spark, rows, monkeypatch, hot_rows):
    monkeypatch.setattr(components, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(components, "HOT_SHARE", 10)
    edges = graph(hot_rows)
    df = spark.createDataFrame(edges, "l string, r string").withColumns({"v": F.lit(1), "a": F.lit(2), "hook": F.lit(3)})
    assert rows(components.connected_groups(df, "l", "r"), "id", "groupid") == brute(edges)


def test_empty_and_numbers(spark, rows):
    none = spark.createDataFrame([], "l bigint, r bigint")
    assert components.connected_groups(none, "l", "r").count() == 0
    loops = spark.createDataFrame([(1, 1), (None, 2)], "l bigint, r bigint")
    assert components.connected_groups(loops, "l", "r").count() == 0
    df = spark.createDataFrame([(10, 9), (9, 100)], "l bigint, r bigint")
    assert rows(components.connected_groups(df, "l", "r")) == [(10, 9), (100, 9), (9, 9)]


def test_verdicts(spark):
    forms = ["IDENTICAL", " identical ", "Likely-Identical", "LIKELY IDENTICAL", "likely_identical", "NOT_IDENTICAL", "NOT IDENTICAL", "Different", "", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, v string").select("i", components.positive(F.col("v")).alias("p"))
    assert [r.p for r in df.orderBy("i").collect()] == [True] * 5 + [False] * 5
