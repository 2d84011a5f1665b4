from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from garimpo.operators import units

CAPACITIES = [
    ("1,92 TB", None, 1_920_000_000_000), ("0.256TB", None, 256_000_000_000), ("119 GiB", None, 119 * 2**30), ("5.5 TiB", None, 6_047_313_952_768),
    ("1000000 MB", None, 10**12), ("cap. 500GB nominal", None, 500 * 10**9), ("128 gigas", None, 128 * 10**9), ("2 tera", None, 2 * 10**12), ("1000G", None, 10**12),
    ("1.000 GB", "HD 1TB", 10**12), ("1.920 GB", None, 1_920 * 10**9), ("128,0 GB", None, 128 * 10**9), ("Kit 32GB (2x16GB)", None, 32 * 10**9), ("64GB (2×32)", None, 64 * 10**9),
    ("2x8GB", None, 16 * 10**9), ("8GB x4", None, 32 * 10**9), ("2 pentes de 4GB", None, 8 * 10**9), ("8192 MiB", None, 2**33),
    ("1", "Disco 1 TB 6 Gb/s", 10**12), ("256", "SSD 256GB 130MB/s", 256 * 10**9), ("480", "sem capacidade", None), ("n/d", "SSD 1TB", None), ("?", None, None), ("", None, None), (None, "1TB", None),
]
PRICES = [
    ("R$ 1.234,56", None, 123456), ("R$ 2,473.30", 2473.3, 247330), ("R$ 1.154", None, 115400), ("BRL 387.00", None, 38700), ("R$ 444,20", None, 44420), ("R $ 1 038,90", None, 103890),
    ("R$ ４２９,９０", None, 42990), ("45850 centavos", None, 45850), ("429 reais e 90 centavos", None, 42990), ("387 reais", None, 38700), ("R$ 0,3 mil", None, 30000), ("R$ 2,3 mil", None, 230000),
    ("de R$ 1.119,38 por R$ 532,60", None, 53260), ("R$ 487,10 à vista ou 10x de R$ 48,71", None, 48710), ("10x de R$ 53,79 sem juros", None, 53790), ("por R$ 240,00 à vista", 240.0, 24000),
    ("R$ --,--", None, None), ("Consulte", None, None), ("", None, None), (None, 5.0, None),
]


@pytest.mark.parametrize("cases,read", [(CAPACITIES, units.capacity), (PRICES, units.price)])
def test_readings(spark, cases, read):
    kind = "string" if read is units.capacity else "double"
    df = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(cases)], f"i int, t string, k {kind}")
    got = {r.i: r.a for r in df.select("i", read(F.col("t"), F.col("k"))["amount"].alias("a")).collect()}
    wrong = [(cases[i], got[i]) for i in got if (got[i] is None) != (cases[i][2] is None) or (got[i] is not None and abs(got[i] - cases[i][2]) > 0.6)]
    assert not wrong


def test_identity_decides_and_flags(spark):
    c, i = (lambda *x: F.array(*[F.lit(float(v)) for v in x])), F.array
    one = spark.range(1)
    pick = lambda cs, ids: one.select(units.choose(cs, ids).alias("c")).first().c
    assert pick(c(1000, 1), c(1)).asDict() == {"amount": 1.0, "residual": 0.0, "unique": True}
    assert pick(c(10, 1000), i().cast("array<double>")).asDict() == {"amount": 10.0, "residual": None, "unique": False}
    assert pick(c(100, 101), c(100.5)).unique is False
    assert pick(i().cast("array<double>"), c(1)) is None


def test_rows_in_usual_form_blank_rows_and_repeats(spark, rows):
    data = [("1", "500GB"), ("2", "0,5 TB"), ("2", "0,5 TB"), ("3", None), ("4", ""), ("5", "x" * 100_000 + " 2 TB")]
    df = spark.createDataFrame(data, "id string, c string").withColumns({"field": F.lit("x"), "amount": F.lit(1)})
    fields = [("c", units.capacity(F.col("c")), units.USUAL_CAPACITY)]
    assert rows(units.in_common_units(df, fields, "t"), "id", "field", "amount") == [("2", "c", 500 * 10**9), ("5", "c", 2 * 10**12)]
    assert units.in_common_units(df.limit(0), fields, "t").count() == 0


def test_identities_are_tested(spark):
    """Modules times size against the total in the same text, instalments times their count against the cash price."""
    read = lambda c: (lambda r: (r.amount, r.residual is not None and r.residual < units.SAME, r.unique))(spark.range(1).select(c.alias("x")).first().x)
    assert read(units.capacity(F.lit("32GB (2x16GB)"))) == (32e9, True, True) and read(units.capacity(F.lit("64 GB (2x32)"))) == (64e9, True, True)
    assert read(units.capacity(F.lit("32GB (2x8GB)"))) == (32e9, False, False)
    assert read(units.price(F.lit("R$ 1.234 ou 10x de R$ 123,40"))) == (123400.0, True, True)
    assert read(units.price(F.lit("R$ 1.234"))) == (123400.0, False, False) and read(units.price(F.lit("R$ 1.234"), F.lit(1234.0))) == (123400.0, True, True)
    assert read(units.price(F.lit("R$ 1.234,00"), F.lit(99.0))) == (123400.0, False, False)
