from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from garimpo.llm import listings

ROWS = [
    ("01", "SSD Vortaq Apex AB-12345 Pro 1TB NVMe", "Vortaq", "AB12345"), ("02", "Vortaq | ab12345 PRO | Disco Sólido SSD | 1000GB | 6Gb/s | 100% novo", "vortaq ", None), ("03", "SSD AB 12345Pro 1,0 TB Oferta!", "VORTAQ", "GB"),
    ("04", "SSD Vortaq AB12345 1TB", "Vortaq", None), ("05", "SSD Vortaq AB12345 Pro 2TB", "Vortaq", None), ("06", "Hexalume AB12345 Pro SSD 1TB", None, None), ("07", "Case Externo para SSD Vortaq AB12345 Pro 1TB", "Vortaq", None),
    ("08", "Memória Vortaq CD54321 2x8GB 3200MHz", "Vortaq", None), ("09", "RAM Vortaq CD54321 Kit 16 GB 2x8", "Vortaq", None), ("10", "Memória Vortaq CD 54321 16GB (2x8GB)", "Vortaq", None), ("11", "Memória Vortaq CD54321 16GB", "Vortaq", None),
    ("12", "Memória Vortaq CD54321 1x16GB", "Genérico", None), ("13", "HDMI/DP 192-bit Placa Nova Era EF11111 Max 8GB", "Nova Era", None), ("14", "Placa Nova Era EF11111Max 8 GB", "nova era ", None),
    ("15", None, None, None), ("16", "", "", ""), ("17", "sem código nenhum", "Vortaq", None), ("18", "SSD GH22222 Lite 500GB", "", None), ("19", "SSD Vortaq GH22222 lite 500GB " + "x " * 3000, None, None),
]
GROUPS = [{"01", "02", "03"}, {"08", "09", "10"}, {"11", "12"}, {"13", "14"}, {"18", "19"}]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id string, title string, brand string, model string")


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([(1, "Vortaq", None), (2, "Hexalume", "HXL")], "id int, name string, short string")


def expected():
    return sorted((a, b) for g in GROUPS for a in g for b in g if a < b)


def test_pairs(frame, reference, rows):
    # 18 names no brand: it joins the only brand known for its model, suffix and capacity.
    assert rows(listings.pairs(listings.groups(frame, reference))) == expected()


def test_repeats_and_extra_columns(frame, reference, rows):
    twice = frame.unionByName(frame).withColumns({"t": F.lit(1), "size": F.lit(2), "key": F.lit(3), "item": F.lit(4)})
    assert rows(listings.pairs(listings.groups(twice, reference))) == expected()


def test_empty(frame, reference):
    assert listings.groups(frame.limit(0), reference).count() == 0
    assert listings.groups(frame, reference.limit(0)).count() == 16


def test_large_groups_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(listings, "PAIR_BLOCK", 7)
    df = spark.range(40).selectExpr("format_string('%03d', id) AS id", "'x' AS item")
    got = listings.pairs(df)
    assert got.count() == 40 * 39 // 2 and got.distinct().count() == 40 * 39 // 2


def test_bare_codes_are_items(spark, reference, rows):
    """Listings that show only a code: copies are one item, and join the only brand known for the same; another code is another item."""
    data = [("1", "Oferta KL77777", None, None), ("2", "KL-77777", "", None), ("3", "MN88888", None, None), ("4", "MN88888", "Vortaq", None), ("5", "PQ99999", None, None)]
    members = listings.groups(spark.createDataFrame(data, "id string, title string, brand string, model string"), reference)
    assert rows(members, "id") == [("1",), ("2",), ("3",), ("4",), ("5",)]
    assert rows(listings.pairs(members)) == [("1", "2"), ("3", "4")]


def test_rare_suffixes_are_kept_by_code(spark, reference, rows):
    """A word that is glued to a code, or follows it in a model column, is a suffix of that code, however rare.

    One that stands after codes only is a suffix of any code it follows; one that stands elsewhere as well is none.
    """
    common = [(f"c{i:03d}", f"SSD Vortaq RS{10000 + i}Pro 1TB", "Vortaq", None) for i in range(250)]
    data = [
        ("1", "SSD Vortaq AB12345 Ultra 1TB", "Vortaq", None), ("2", "SSD Vortaq AB12345 1TB", "Vortaq", None), ("3", "Vortaq AB12345Ultra SSD 1TB", "Vortaq", None), ("4", "SSD 1TB Vortaq ab-12345", "Vortaq", None),
        ("5", "SSD Vortaq CD54321 Extreme 1TB", "Vortaq", "CD54321 Extreme"), ("6", "SSD Vortaq CD54321 1TB", "Vortaq", "CD54321"), ("7", "Vortaq CD54321 extreme 1TB SSD", "Vortaq", None),
        ("8", "SSD Vortaq EF11111 Ultra 1TB", "Vortaq", None), ("9", "SSD Vortaq EF11111 1TB", "Vortaq", "EF11111 SSD"), ("A", "SSD Gamer Vortaq EF11111 1TB", "Vortaq", None), ("B", "SSD Vortaq EF11111 Gamer 1TB", "Vortaq", None),
    ]
    members = listings.groups(spark.createDataFrame(common + data, "id string, title string, brand string, model string"), reference)
    assert rows(listings.pairs(members)) == [("1", "3"), ("2", "4"), ("5", "7"), ("9", "A"), ("9", "B"), ("A", "B")]


#: Titles in the style of shops, with the item of each; "-" stands alone.
SHOP = [
    ("a400", "SSD Kingston A400 480GB SATA"), ("a400", "Kingston A400 SSD 480 GB 2.5"), ("a400tb", "SSD Kingston A400 1TB SATA"), ("990pro", "SSD Samsung 990 PRO 2TB M.2 PCIe Gen4 NVMe"), ("990pro", "Samsung SSD 990PRO 2TB NVMe M.2"),
    ("990pro", "SSD 2TB Samsung 990 Pro M.2 2280"), ("990", "SSD Samsung 990 2TB"), ("evo", "SSD 870 EVO 500GB Samsung"), ("evo", "SSD Samsung 870 EVO 500GB SATA III 2.5"), ("qvo", "SSD 870 QVO 500GB Samsung"), ("qvo", "SSD Samsung 870 QVO 500GB"),
    ("nv3", "SSD Kingston NV3 1TB M.2 2280"), ("nv3", "Kingston NV3 SSD M.2 NVMe 1TB"), ("5070ti", "Placa de Video RTX 5070 Ti 16GB GDDR7"), ("5070ti", "RTX 5070 Ti GDDR7 16GB Placa de Video"), ("5070", "Placa de Video RTX 5070 16GB"),
    ("mx500", "SSD Crucial MX500 1TB"), ("mx500", "Crucial MX500 SSD 1TB SATA"), ("850x", "SSD WD Black SN850X 2TB"), ("850x", "WD Black SN850X SSD 2TB NVMe"), ("850", "SSD WD Black SN850 2TB"),
    ("beast", "Kingston Fury Beast 16GB DDR4"), ("beast", "Kingston Fury Beast 16GB DDR4"), ("renegade", "Kingston Fury Renegade 16GB DDR4"), ("only", "Cadeira Escritorio"),
]


def test_titles_in_the_style_of_shops(spark, rows):
    """Short codes, bare numbers, variants that are words, and titles without any code."""
    brands = spark.createDataFrame([(1, "Kingston", None), (2, "Samsung", None), (3, "Crucial", None), (4, "WD", "WD")], "id int, name string, short string")
    data = [(f"{i:02d}", t, None, None) for i, (_, t) in enumerate(SHOP)]
    members = listings.groups(spark.createDataFrame(data, "id string, title string, brand string, model string"), brands)
    assert members.count() == len(SHOP)
    want = sorted((f"{i:02d}", f"{j:02d}") for i, (a, _) in enumerate(SHOP) for j, (b, _) in enumerate(SHOP) if i < j and a == b)
    assert rows(listings.pairs(members)) == want


def test_long_brand_names_are_found_in_titles(spark, rows):
    brands = spark.createDataFrame([(1, "Casa das Memorias e Discos Ltda Sul", None)], "id int, name string, short string")
    data = [("1", "SSD Casa das Memorias e Discos Ltda Sul AB12345 1TB", None, None), ("2", "SSD AB12345 1TB", "Casa das Memorias e Discos Ltda Sul", None), ("3", "SSD Outra AB12345 1TB", "Outra", None)]
    assert rows(listings.pairs(listings.groups(spark.createDataFrame(data, "id string, title string, brand string, model string"), brands))) == [("1", "2")]
