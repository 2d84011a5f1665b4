from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from garimpo.llm import canonical_values as cv

REFERENCE = [(1, "Vortaq", None), (2, "Hexalume", "HXL"), (3, "Cobalt & Finch", "C&F"), (4, "Maré Alta Sistemas", None), (5, "Aço Digital", None)]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REFERENCE, "id int, name string, short string")


CASES = [
    ("vORTAQ", 1), ("Vor taq", 1), ("Vor​taq", 1), ("Vort@q", 1), ("Voratq", 1), ("Vоrtaq", 1), ("Marca: Vortaq", 1), ("Vortaq - Loja Oficial", 1), ("Vortaq (Oficial)", 1), ("Vortaq®", 1), ("* Vortaq", 1),
    ("hxl", 2), ("Hexa1ume Brasil", 2), ("HTEXALLUME", 2), ("c&f", 3), ("FINCH & COBALT", 3), ("Cobalt && Finhc", 3), ("SISTEMAS ALTA MARÉ", 4), ("Mare Alta Sisteams LTDA", 4), ("DIGITAL AÇO", 5),
    ("Xodobyte", -1), ("?", -1), ("N/A", -1), ("genérico", -1), ("x" * 5000, -1),
]


def test_cases(spark, reference):
    df = spark.createDataFrame([(c,) for c, _ in CASES] * 2 + [(None,)], "value string")
    got = {r.value: r.id for r in cv.map_values(df, reference).collect()}
    assert got == dict(CASES)


def test_rows_skip_blank_and_exact(spark, reference, rows):
    df = spark.createDataFrame([("1", "Vortaq"), ("2", "  \t "), ("3", ""), ("4", None), ("5", "vortaq"), ("6", "nada")], "id string, brand string").withColumns({"value": F.lit(0), "name": F.lit("z"), "short": F.lit("z")})
    assert rows(cv.map_rows(df, "id", "brand", reference, "brandid")) == [("5", 1), ("6", -1)]
    assert cv.map_rows(df.limit(0), "id", "brand", reference, "brandid").count() == 0
    assert rows(cv.map_rows(df, "id", "brand", reference.limit(0), "brandid")) == [("1", -1), ("5", -1), ("6", -1)]


def test_long_references_are_not_broadcast(spark, reference, rows, monkeypatch):
    monkeypatch.setattr(cv, "BROADCAST_NAMES", 1)
    df = spark.createDataFrame([("1", "Vortaq"), ("5", "vortaq"), ("6", "nada")], "id string, brand string")
    assert rows(cv.map_rows(df, "id", "brand", reference, "brandid")) == [("5", 1), ("6", -1)]


def test_pigeonhole_join_loses_nothing(spark, reference):
    """Against brute force over random edits: every value within the allowed distance is found."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def edit(s):
        s = list(s)
        for _ in range(r.randrange(5)):
            at = r.randrange(len(s))
            s[at : at + r.randrange(2)] = [r.choice(letters)] * r.randrange(2)
            s = s or ["a"]
        return "".join(s)

    values = sorted({edit(n.lower()) for _, n, _ in REFERENCE for _ in range(60)})
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r.value: (r.id, r.distance) for r in cv.map_values(df, reference).collect()}
    bare = {v: x for v, x in df.selectExpr("value", f"replace({cv.bare_sql('value')}, ' ', '') AS b").collect()}
    names = {i: x for i, x in reference.selectExpr("id", f"replace({cv.bare_sql('name')}, ' ', '') AS b").collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    allowed = lambda n: next(k for least, k in cv.EDITS if len(n) >= least)
    for v in values:
        near = {i: lev(bare[v], n) for i, n in names.items() if bare[v] and lev(bare[v], n) <= allowed(n)}
        if near:
            assert got[v][1] is not None or len(near) > 1, v
            assert got[v][1] is None or got[v][1] <= min(near.values()), v
