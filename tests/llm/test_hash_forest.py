from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from garimpo.llm import hash_forest, product_numbers


def brute(data):
    seen, out = {}, set()
    for i, keys in sorted({(i, tuple(k)) for i, k in data}):
        for k in keys:
            if k in seen and seen[k] < i:
                out.add((i,))
            seen.setdefault(k, i)
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_repeated_rows_equal_brute_force(spark, rows, batches):
    r = random.Random(batches)
    data = [(f"{i:04d}", ["hot"] if r.random() < 0.3 else [f"k{r.randrange(150)}" for _ in range(r.randrange(3))]) for i in range(300)]
    data += data[:30]
    df = spark.createDataFrame(data, "id string, identities array<string>").withColumns({"key": F.lit(1), "first": F.lit(2)})
    assert rows(hash_forest.repeated_rows(df, batches)) == brute(data)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id string, identities array<string>")
    assert hash_forest.repeated_rows(none).count() == 0
    one = spark.createDataFrame([("a", ["x"]), ("a", ["x"]), ("b", []), ("c", None)], "id string, identities array<string>")
    assert hash_forest.repeated_rows(one).count() == 0


def test_near_duplicates_reach_the_recall_target(spark):
    """Five-word shingles with a similarity of 0.8: recall against brute force over all pairs of history and batch."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(60)] for _ in range(120)]

    def shingles(ws):
        return [" ".join(ws[k : k + 5]) for k in range(len(ws) - 4)]

    near = []
    for ws in base:
        ws = list(ws)
        ws[r.randrange(len(ws))] = "changed"
        near.append(ws)
    schema = "key string, features array<string>, first string"
    old = spark.createDataFrame([(f"o{i}", shingles(w), f"o{i}") for i, w in enumerate(base)], schema)
    new = spark.createDataFrame([(f"n{i}", shingles(w), f"n{i}") for i, w in enumerate(near)], schema)
    forest = hash_forest.HashForest(spark, trees=4, depth=7, recall=0.95, verify=hash_forest.jaccard_from(0.8))
    assert forest.accept(old).filter("known").count() == 0
    got = {x.key: x["first"] for x in forest.accept(new).filter("known").collect()}
    want = {f"n{i}": f"o{i}" for i, w in enumerate(near) if len(set(shingles(w)) & set(shingles(base[i]))) >= 0.8 * len(set(shingles(w)) | set(shingles(base[i])))}
    assert want and all(got[k] == want[k] for k in got) and len(got) >= 0.9 * len(want)
    assert 0 < forest.reached[-1][0] < 7


def test_few_near_duplicates_are_found_without_one_in_the_sample(spark):
    """20 near-duplicates in a batch of 320, none in the sample: the prefix must not stay at whole signatures."""
    r = random.Random(7)
    words = lambda: [f"w{r.randrange(400)}" for _ in range(60)]
    shingles = lambda ws: [" ".join(ws[k : k + 5]) for k in range(len(ws) - 4)]
    base = [words() for _ in range(20)]
    near = [[*ws[:30], "changed", *ws[31:]] for ws in base]
    schema = "key string, features array<string>, first string"
    old = spark.createDataFrame([(f"o{i}", shingles(w), f"o{i}") for i, w in enumerate(base)], schema)
    new = spark.createDataFrame([(f"n{i}", shingles(w), f"n{i}") for i, w in enumerate(near + [words() for _ in range(300)])], schema)
    forest = hash_forest.HashForest(spark, trees=4, depth=7, recall=0.95, sample=1, verify=hash_forest.jaccard_from(0.8))
    forest.accept(old)
    got = {x.key: x["first"] for x in forest.accept(new).filter("known").collect()}
    assert len(got) >= 18 and all(got[k] == f"o{k[1:]}" for k in got)
    assert hash_forest.HashForest(spark).longest() == 4


def numbered(spark, low, high):
    return spark.range(low, high).selectExpr("string(id) AS key", "array(string(id)) AS features", "string(id) AS first")


def test_a_small_batch_reads_few_rows_of_history(spark):
    """Rows read grow with the batch, not with history; folders and ranges of signatures are pushed into the scan."""
    forest = hash_forest.HashForest(spark, trees=1, depth=7, head_rows=500)
    forest.insert(forest.signatures(numbered(spark, 0, 20_000)))
    assert forest.runs[0].bits >= 5
    read = {}
    for n in (3, 30, 3000):
        batch = forest.signatures(numbered(spark, 0, n))
        near = forest.near(batch, 7)
        read[n] = near.count()
        assert forest.locate(batch).count() == n
    assert read[3] < 100 and read[30] < 1500 and read[3000] > 15_000
    plan = forest.near(forest.signatures(numbered(spark, 0, 3)), 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "head" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(sig" in plan.split("PushedFilters: [")[1]


def test_ranges_cover_all_cells():
    r = random.Random(1)
    for _ in range(50):
        cells = [r.randrange(4096) for _ in range(r.randrange(1, 200))]
        ranges = hash_forest.merged_ranges(cells, 8)
        assert len(ranges) <= 8 and all(any(a <= c <= b for a, b in ranges) for c in cells)
        assert all(a in cells and b in cells for a, b in ranges) and ranges == sorted(ranges)
    assert hash_forest.merged_ranges([]) == []


def test_a_missed_target_falls_back_to_common_features(spark):
    """One tree can't reach the target; the exact comparison is used instead and reported."""
    shingles = lambda ws: [" ".join(ws[k : k + 5]) for k in range(len(ws) - 4)]
    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(60)]
    near = [[*ws[:30], "changed", *ws[31:]] for ws in base]
    schema = "key string, features array<string>, first string"
    forest = hash_forest.HashForest(spark, trees=1, depth=2, recall=1.0, verify=hash_forest.jaccard_from(0.8))
    forest.accept(spark.createDataFrame([(f"o{i}", shingles(w), f"o{i}") for i, w in enumerate(base)], schema))
    found = forest.accept(spark.createDataFrame([(f"n{i}", shingles(w), f"n{i}") for i, w in enumerate(near)], schema))
    assert found.filter("known").count() == 60 and forest.reached == [(0, 1.0)]


def test_similar_texts_against_brute_force(spark, rows):
    r = random.Random(11)
    base = [" ".join(f"w{r.randrange(60)}" for _ in range(40)) for _ in range(40)]
    data = [(f"r{i:05d}", base[i % 40] if i % 3 else base[i % 40] + f" extra{i % 7}") for i in range(300)] + [("r00300", None), ("r00400", ""), ("r00500", "one two"), ("r00600", "one two")]
    sets = {i: frozenset(" ".join(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) if t else None for i, t in data}
    want = []
    for i, s in sets.items():
        if s and int(i[1:]) % 10 == 0:
            near = {j: x for j, x in sets.items() if x and len(s & x) >= 0.8 * len(s | x)}
            want.append((i, min(near), len(set(near.values())) - 1))
    df = spark.createDataFrame(data, "id string, text string").withColumns({"key": F.lit(1), "features": F.lit("x")})
    got = rows(hash_forest.similar_texts(df, F.substring("id", 2, 9).cast("int") % 10 == 0), "id", "first", "links")
    assert len(set(got) & set(want)) >= 0.95 * len(want) and len(got) == len(want)
    assert rows(hash_forest.similar_texts(df.filter("text = ''"), F.lit(True))) == []


def test_runs_are_merged(spark):
    forest = hash_forest.HashForest(spark)
    for b in range(4):
        forest.accept(spark.range(b * 10, b * 10 + 10).selectExpr("string(id) AS key", "array(string(id)) AS features", "string(id) AS first"))
    assert len(forest.runs) < 4 and forest.history().filter("tree = 0").count() == 40
    assert len([p for p in Path(forest.path.removeprefix("file:")).iterdir() if p.name.startswith(("run-", "batch-"))]) == len(forest.runs)
    again = forest.accept(spark.range(5, 45).selectExpr("string(id) AS key", "array(string(id)) AS features", "'zz' AS first"))
    assert again.filter("known").count() == 35


FORMS = [
    ("LN-203706092", None), ("ln 203706092 ", None), ("LN-203.706.092", None), ("#203706092", None), ("000203706092", None), (None, "https://www.loja.example/produto/203706092/ssd-1920gb"),
    (None, " HTTPS://M.LOJA.EXAMPLE/produto/203706092/x/?sid=918228904 "), (None, "https://r.loja.example/out?pos=4&to=https%3A%2F%2Floja.example%2Fp%2Fram-2x8gb%2F203706092"), (None, "https://loja.example/ssd-512-gb-p203706092.html#avaliacoes"),
    (None, "https://loja.example/item?id=203706092&ref=drive%2Dssd-12345678901"), (None, "https://loja.example/203706092-memoria?utm_campaign=c9"), (None, "https://loja.example/catalogo/203706092"),
]


def test_product_numbers(spark):
    df = spark.createDataFrame(FORMS, "i string, u string")
    got = [r.x for r in df.select(product_numbers.identities(F.lit("Loja "), F.col("i"), F.col("u")).alias("x")).collect()]
    assert got == [["loja#203706092"]] * len(FORMS)
    odd = spark.createDataFrame([(None, None), ("", " "), ("B0-x7k", None), (None, "https://loja.example/sobre?x=1")], "i string, u string")
    assert [r.x for r in odd.select(product_numbers.identities(F.lit(None).cast("string"), F.col("i"), F.col("u")).alias("x")).collect()] == [[], [], ["#b0x7k"], ["#https://loja.example/sobre"]]
