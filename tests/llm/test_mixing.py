from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from garimpo.llm import mixing

SIZED = [(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(300)] + [(1000, None, 5), (1001, "z", 5), (1002, "a", 0)]
TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("lost", 0.2, 2), ("none", None, None)]


@pytest.fixture(scope="module")
def sized(spark):
    return spark.createDataFrame(SIZED, "doc_id bigint, source string, tokens bigint")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, targetshare double, maxrepeats int")


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_shares_and_caps(sized, targets, range_rows):
    budget = mixing.budgets(sized, targets)
    got = mixing.draw(sized, budget, range_rows=range_rows)
    shares = {r.source: r for r in mixing.shares(got, budget).collect()}
    assert set(shares) == {"a", "b", "lost", "none"} and shares["lost"].tokens == 0 and shares["lost"].share == 0
    for s in "ab":
        r = shares[s]
        assert r.budget - 17 < r.tokens <= r.budget and r.mostrepeats <= r.maxrepeats
    assert abs(shares["a"].share - 0.5 / 0.8) < 0.02
    repeats = [r.repeats for r in got.filter("source = 'b'").collect()]
    assert max(repeats) - min([*repeats, *([0] if len(repeats) < 100 else [])]) <= 1


def test_partition_does_not_matter(sized, targets, rows):
    budget = mixing.budgets(sized, targets, total=1000)
    one = rows(mixing.draw(sized, budget, range_rows=5))
    assert one == rows(mixing.draw(sized.repartition(5), budget, range_rows=1000)) and one
    assert one != rows(mixing.draw(sized, budget, seed=1))


def test_empty(spark, sized, targets):
    none = sized.limit(0)
    budget = mixing.budgets(none, targets)
    assert mixing.draw(none, budget).count() == 0 and {r.tokens for r in mixing.shares(mixing.draw(none, budget), budget).collect()} == {0}
    assert mixing.draw(sized, mixing.budgets(sized, targets.limit(0))).count() == 0


def test_token_counts(spark):
    path = mixing.TOKENIZER
    if not Path(path).exists():
        pytest.skip("no tokenizer files here")
    df = spark.createDataFrame([(1, "olá mundo"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id bigint, text string").withColumn("tokens2", F.lit(1))
    got = {r.doc_id: r.tokens for r in mixing.token_counts(df).collect()}
    assert got[1] > 1 and got[2] == got[3] == 0 and got[4] > 1
