"""Cases of titles, prices, devices and comparisons with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from garimpo.functions import failures, prices, relevance, storage, titles, urls
from garimpo.operators import compare, dedup, pairs, statistics
from garimpo.plans import listing_queries
from garimpo.sources import pages
from garimpo.sources.listings import listings

LEFT = [
    ("samsung-990-pro-2tb", "SSD Samsung 990 PRO 2TB M.2 PCIe Gen4 NVMe"), ("kingston-a400-480gb", "SSD Kingston A400 480GB SATA"), ("wd-blue-sn580-1tb", "SSD WD Blue SN580 1TB NVMe M.2"),
    ("corsair-mp600-1tb", "SSD Corsair MP600 1TB PCIe Gen4 NVMe"), ("samsung-980-pro-1tb", "SSD Samsung 980 PRO 1TB M.2 PCIe Gen3 NVMe"), ("samsung-970-evo-500gb", "SSD Samsung 970 EVO 500GB M.2 NVMe"),
    ("kingston-a2000-1tb", "SSD Kingston A2000 1TB M.2 PCIe NVMe"), ("kingston-kc3000-2tb", "SSD Kingston KC3000 2TB M.2 PCIe Gen4 NVMe"), ("wd-black-sn850x-2tb", "SSD WD Black SN850X 2TB M.2 PCIe Gen4 NVMe"),
    ("wd-green-1tb", "SSD WD Green 1TB SATA"), ("corsair-mp600-pro-2tb", "SSD Corsair MP600 PRO 2TB M.2 PCIe Gen4 NVMe"), ("corsair-sfu-512gb", "SSD Corsair SFU 512GB M.2 NVMe"),
]
RIGHT = [
    ("samsung-990-pro-2tb", "SSD Samsung 990 Pro 2 TB NVMe M.2"), ("kingston-a400-480gb", "SSD Kingston SA400S37/480G A400 480GB SATA"), ("wd-blue-sn580-1tb", "SSD Western Digital Blue SN580 1TB M.2 NVMe"),
    ("corsair-mp600-1tb", "SSD Corsair Force MP600 1TB PCIe 4.0 NVMe"), ("samsung-870-evo-1tb", "SSD Samsung 870 EVO 1TB SATA"), ("samsung-980-pro-1tb", "SSD Samsung 980 PRO 1TB NVMe M.2"),
    ("samsung-970-evo-500gb", "SSD Samsung 970 EVO 500GB M.2 NVMe"), ("kingston-a2000-1tb", "SSD Kingston A2000 1TB M.2 NVMe"), ("kingston-kc3000-2tb", "SSD Kingston KC3000 2TB PCIe Gen4 NVMe"),
    ("wd-black-sn850x-2tb", "SSD Western Digital Black SN850X 2TB NVMe"), ("wd-green-1tb", "SSD WD Green 1TB SATA"), ("corsair-mp600-pro-2tb", "SSD Corsair MP600 PRO 2TB PCIe Gen4 NVMe"), ("corsair-sfU-512gb", "SSD Corsair SFU 512GB M.2 NVMe"),
]
PAIRS = [
    ("SSD Samsung 990 PRO 2TB M.2 PCIe Gen5", "SSD Samsung 990 PRO 2TB PCIe Gen5 NVMe", "LIKELY_IDENTICAL", 0.87), ("SSD Kingston A400 480GB SATA", "SSD Kingston SV300S37/480G A400 480GB", "DIFFERENT", 0.69),
    ('SSD Samsung 870 EVO 500GB 2.5" SATA', "SSD Samsung 990 PRO 2TB M.2 PCIe Gen5", "DIFFERENT", 0.42), ("SSD Corsair MP600 1TB PCIe Gen4 NVMe", "SSD Corsair MP600 1TB NVMe M.2", "IDENTICAL", 0.98),
    ('SSD Samsung 870 EVO 500GB 2.5" SATA', 'SSD Samsung 870 EVO 1TB 2.5" SATA', "DIFFERENT", 0.69), ("SSD Kingston A400 480GB SATA", "SSD WD Blue SN580 500GB", "UNKNOWN", 0.39),
    ("SSD NVMe 500GB", "SSD M.2 500GB", "LIKELY_IDENTICAL", 0.82), ("Kingston SV300S37/480G", "Kingston SV300S37/480G A400 480GB", "IDENTICAL", 0.96), ("SSD Lexar NM790 4TB PCIe Gen5", "SSD Lexar NM790 4TB NVMe M.2", "LIKELY_IDENTICAL", 0.86),
]


def devices(spark, data):
    return storage.canonical(spark.createDataFrame(data, "id string, title string"))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_golden_pairs(spark):
    judged = pairs.against(devices(spark, LEFT), devices(spark, RIGHT), ["id"])
    r = statistics.confusion(judged, F.col("verdict").isin("IDENTICAL", "LIKELY_IDENTICAL"), F.col("l_id") == F.col("r_id")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (10, 1, 1, 144)


def test_pair_cases(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a string, b string, v string, c double")
    side = lambda t, n: storage.canonical(df, t).select("i", F.struct(*compare.INPUTS).alias(n))
    got = compare.compare(df.join(side("a", "l"), "i").join(side("b", "r"), "i")).select("v", "c", "verdict", "confidence").collect()
    assert all(r.v == r.verdict and r.c == r.confidence for r in got)


def test_missing_side_and_zero_capacity(spark):
    one = devices(spark, [("1", "SSD Samsung 870 EVO 500GB")]).select(F.struct(*compare.INPUTS).alias("l"))
    r = compare.compare(one.withColumn("r", F.when(F.lit(False), F.col("l")))).first()
    assert (r.verdict, r.confidence) == ("UNKNOWN", 0.5)
    zero = one.withColumn("l", F.col("l").withField("capacityGB", F.lit(0))).withColumn("r", F.col("l"))
    assert compare.compare(zero).first().status.capacity == "MISMATCH"


def test_blocked_matches_equal_all_pairs(spark, rows):
    data = [(f"{i:03d}", t) for i, (_, t) in enumerate(LEFT + RIGHT + [("", ""), ("", "SSD 500GB NVMe"), ("", "SSD 512GB NVMe"), ("", "Corsair P5 1TB")])]
    df = devices(spark, data)
    want = pairs.each_with_each(df, "id", []).filter(F.col("verdict").isin("IDENTICAL", "LIKELY_IDENTICAL"))
    assert rows(pairs.matching(df, "id", []), "l_id", "r_id", "confidence") == rows(want, "l_id", "r_id", "confidence")


def test_offers_use_each_device_once(spark):
    got = pairs.offer_pairs(devices(spark, [(f"{i:03d}", t) for i, (_, t) in enumerate(LEFT + RIGHT)]), "id").collect()
    used = [x for r in got for x in (r.first, r.second) if x is not None]
    assert sorted(used) == [f"{i:03d}" for i in range(25)]


@pytest.mark.parametrize("title,want", [("⭐ SSD Samsung 500GB", "SSD Samsung 500GB"), (None, ""), ("Produto Patrocinado  X  10x de R$ 9,90 Y", "X Y"), ("A Avaliação 4,5 de 5 B", "A B"), ("CPU (5ª", "CPU (5ª"), ("CPU (5a Geração) (6a Geração)", "CPU (6a Geração)")])
def test_clean_title(spark, title, want):
    assert value(spark, titles.clean_title(F.lit(title))) == want


@pytest.mark.parametrize("title,want", [("ssd samsung 500gb", "samsung"), ("HD Western Digital 1TB", "Western Digital"), ("GeForce RTX 3060 NVIDIA", "NVIDIA"), ("Fonte Be Quiet! 600W", "Be Quiet"), ("nada", None), (None, None)])
def test_brand(spark, title, want):
    assert value(spark, titles.brand(F.lit(title).cast("string"))) == want


def test_attributes(spark):
    text = lambda f, x: value(spark, f(F.lit(x).cast("string")))
    assert "5700X" in text(titles.model, "AMD Ryzen 7 5700X") and "EVO" in text(titles.model, "SSD Samsung 870 EVO 500GB") and text(titles.model, "") is None
    assert text(titles.storage_capacity, "SSD 1.92TB NVMe") == "1.92TB" and text(titles.storage_capacity, "Ryzen 7") is None
    assert text(titles.memory_capacity, "Memória RAM DDR4 16GB") == "16GB" and text(titles.memory_capacity, "SSD 1TB NVMe") is None
    assert value(spark, titles.availability(F.lit("SSD"), F.lit("Esgotado"), F.lit("kabum"))) == "out_of_stock"
    assert value(spark, titles.availability(F.lit(""), F.lit("R$ 1"), F.lit("kabum"))) == "unknown"


@pytest.mark.parametrize("text,want", [("R$ 1.299,90", 1299.9), ("R$ 599,00", 599.0), ("10x de R$ 53,79", 53.79), ("R$ 90,00 ou 2x de R$ 50,00", 90.0), ("de R$ 20,00 por R$ 10,00", 10.0), ("1.234", 1234.0), ("x", None), ("", None), (None, None)])
def test_parse_price(spark, text, want):
    assert value(spark, prices.parse_price(F.lit(text).cast("string"))) == want


def test_other_prices(spark):
    assert value(spark, prices.stored_price(F.lit("R$ 450.50"))) == 45050.0 and value(spark, prices.stored_price(F.lit(None).cast("string"))) == 0.0
    assert value(spark, prices.current_price(F.lit(float("inf")), F.lit(""))) == 0.0 and value(spark, prices.current_price(F.lit(None).cast("double"), F.lit("R$ 599,00"))) == 599.0
    assert value(spark, prices.original_price(F.lit(50.0), F.lit("de R$ 70,00 por R$ 50,00"))) == 70.0
    assert value(spark, prices.format_brl(F.lit(1234.5))) == "R$ 1.234,50" and value(spark, prices.format_brl(F.lit(None).cast("double"))) == "N/A"
    assert value(spark, prices.format_ms(F.lit(999))) == "999ms" and value(spark, prices.format_ms(F.lit(1550))) == "1.6s"


def test_devices_without_title(spark):
    got = storage.canonical(spark.createDataFrame([(None,), ("",)], "title string").withColumn("brand", F.lit("own"))).collect()
    assert all(r.brand is None and r.confidence is None for r in got)
    flat = storage.flat(devices(spark, [("1", "SSD 500GB NVMe"), ("2", "SSD 1TB NVMe")])).orderBy("id").collect()
    assert [(r.brand, r.capacity, r.capacityUnit) for r in flat] == [("Unknown", 500.0, "GB"), ("Unknown", 1000.0, "TB")]


def test_relevance(spark):
    assert [k for _, k in relevance.query_tokens("Monitor 29pol ssd 1tb kingston 10")] == ["generic", "unit", "generic", "unit", "unit", "numeric"]
    df = spark.createDataFrame([(1, "SSD Samsung 990 PRO 2TB", "Samsung", None), (2, "Cadeira", None, None)], "id int, title string, brand string, model string")
    got = {r.id: r for r in relevance.scored(df, "Samsung SSD 2TB").collect()}
    assert got[1].score >= 0.6 and got[2].score == 0 and got[2].unmatched == ["samsung", "ssd", "2tb"]
    assert relevance.relevant(df, "").count() == 2 and relevance.relevant(df, "SSD", 0).count() == 1 and relevance.scored(df, "  ").first().score == 1.0


def test_dedup(spark, rows):
    data = [(1, "A", "u1", "p", None), (2, "B", "u1", "p", "s"), (3, "b", "u2", "P", None), (4, "", "u3", "p", None), (5, "", "u4", "p", None), (6, "C", None, "p", None), (7, "C", "u5", None, "q"), (8, "c ", "u6", "q", None)]
    df = spark.createDataFrame(data, "ord int, title string, url string, provider string, source string")
    assert rows(dedup.dedup_listings(df, "ord"), "ord") == [(2,), (4,), (5,), (7,)]
    assert rows(dedup.dedup_listings(df, "ord", keep_without_url=True), "ord") == [(2,), (4,), (5,), (6,), (7,)]
    assert dedup.dedup_listings(df.limit(0), "ord").count() == 0
    assert rows(dedup.first_by_title(df, "ord"), "ord") == [(1,), (2,), (3,), (7,), (8,)]


def test_failures(spark):
    kind = lambda m, n="Error": value(spark, failures.failure_class(F.lit(m).cast("string"), F.lit(n)))
    assert [kind("Timeout"), kind("connect ECONNREFUSED"), kind("not found"), kind("x"), kind("x", "TimeoutError"), kind("x", "TypeError"), kind(None)] == ["retriable", "transient", "permanent", "unknown", "retriable", "permanent", "unknown"]
    assert value(spark, failures.retry_delay(F.lit(3))) == 4000.0 and value(spark, failures.retry_delay(F.lit(9))) == 5000.0


def test_page_codes(spark):
    code = lambda m, n: value(spark, failures.page_code(F.lit(m).cast("string"), F.lit("Error"), F.lit(n)))
    assert [code("403", 0), code("timeout", 0), code(None, 0), code(None, 3), code("x", 1)] == ["CLOUDFLARE", "TIMEOUT", "NO_PRODUCTS", None, "DOM_CHANGED"]
    assert value(spark, failures.is_blocked(F.lit("Em Manutenção"))) and not value(spark, failures.is_blocked(F.lit(None).cast("string")))
    assert [value(spark, titles.is_listing(F.lit(t).cast("string"))) for t in ("SSD", " Ver todas ", "", None)] == [True, False, False, False]


def test_urls(spark):
    assert value(spark, urls.search_slug(F.lit(" fonte rm850x! é "))) == "fonte-rm850x!-%C3%A9"
    assert value(spark, urls.search_page_url("b/", F.lit("a"), F.lit(3))) == "b/a_Desde_97_NoIndex_True"
    p = value(spark, urls.pagination(F.array(*[F.lit(f"h?page={n}") for n in (3, 2, "x", 2)]), F.lit("h?page=1"), "page"))
    assert (p.currentPage, p.pages, p.nextPageUrl, p.hasNextPage) == (1, [2, 3], "h?page=2", True)
    assert value(spark, urls.pagination(F.array().cast("array<string>"), F.lit("h"), "page")).hasNextPage is False


def test_pages(spark, rows):
    marked = '<a data-cy="list-product" href="/x"><h2> T &amp; U </h2><span class="price_vista">R$ 1</span></a><a data-cy="list-product" href="/y"></a>'
    plain = '<a href="/produto/1"><div>Selo: X Y Produto Patrocinado</div><div>Placa muito boa demais</div><div>R$ 100,00</div><p>10x de R$ 10,00</p></a><a href="/produto/1">R$ 2</a><a href="/produto/2">sem</a>'
    listed = '<li class="ui-search-layout__item"><h2>A</h2><a href="https://click.shop.example/1"></a><a href="https://shop.example/2"></a><span class="poly-price__current">R$ 3</span></li><li class="ui-search-layout__item"><i class="ui-search-item__ad"></i><h2>B</h2></li>'
    page = lambda h: spark.createDataFrame([(1, h), (2, None), (3, "")], "page int, html string")
    assert rows(pages.marked_cards(page(marked)), "title", "price_text", "url") == [("T & U", "R$ 1", "/x"), (None, None, "/y")]
    assert rows(pages.plain_cards(page(plain), "page"), "title", "price_text", "url") == [("Placa muito boa demais", "R$ 100,00", "/produto/1")]
    assert rows(pages.listed_cards(page(listed), "shop.example"), "title", "price_text", "url") == [("A", "R$ 3", "https://shop.example/2")]


def test_warranty_is_compared_where_a_side_states_one(spark):
    one = devices(spark, [("1", "SSD Corsair MP600 1TB PCIe Gen4 NVMe")])
    with_months = lambda *m: one.withColumn("warranty", F.explode(F.array(*[F.lit(x).cast("int") for x in m])))
    got = {(r.l.warranty, r.r.warranty): (r.status.warranty, r.verdict, r.confidence) for r in pairs.against(with_months(36, None), with_months(36, 37, 60, None), ["id"]).collect()}
    plain = pairs.against(one, one, ["id"]).first()
    assert got[36, 36][0] == got[36, 37][0] == "MATCH" and got[36, 60][0] == got[36, None][0] == got[None, 60][0] == "MISMATCH" and got[None, None][0] is None
    assert got[None, None][2] == plain.confidence and got[36, 36][2] >= plain.confidence > got[36, 60][2]
    texts = pairs.against(with_months(36), with_months(37, 60, None), ["id"]).select(compare.warranty_reason().alias("w")).collect()
    assert sorted((r.w.leftValue, r.w.rightValue, r.w.reason, r.w.canonicalValue) for r in texts if r.w) == [("36 months", "37 months", "Warranty within tolerance", "36 months"), ("36 months", "60 months", "Warranty mismatch", None), ("36 months", "Unknown", "One warranty unknown", None)]
    rows = pairs.against(one, one, ["id"]).withColumn("e", compare.evidence(compare.reasons())).first().e
    assert rows[0].rule == "manufacturerSku" and all(e.matched == (e.status != "MISMATCH") for e in rows)


def test_other_currencies(spark):
    read = lambda text, currency: value(spark, prices.current_price(F.lit(None).cast("double"), F.lit(text), F.lit(currency)))
    assert read("$ 20 ou R$ 99,90", "BRL") == 99.9 and read("$ 20 e 300 pecas", "USD") == 20.0 and value(spark, prices.parse_price(F.lit("US$ 7,50 em 3x de US$ 2,50"), "US$")) == 7.5


def test_offers_on_normalized_rows(spark):
    """Rows of one brand match whatever their models if only brand and model are compared."""
    df = spark.createDataFrame([(1, "Samsung", "870"), (2, "Samsung", "990"), (3, "Kingston", "A400")], "ord int, brand string, model string")
    got = sorted((r.first, r.second) for r in pairs.offer_pairs(pairs.without_facts(df), "ord").collect())
    assert got == [(1, 2), (3, None)]


def test_offers_are_settled_by_brand_and_capacity_range(spark):
    """The same as taking all matches in one list: ranges of capacities are cut where no match can cross."""
    r = random.Random(4)
    data = [(i, r.choice(["Samsung", "WD", None]), r.choice(["870", "990", None]), r.choice([480, 500, 512, 530, 960, 1000, None])) for i in range(60)]
    df = pairs.without_facts(spark.createDataFrame(data, "ord int, brand string, model string, gb int")).withColumn("capacityGB", F.col("gb"))
    matches = sorted((x.l_ord, x.r_ord) for x in pairs.matching(df, "ord", []).collect())
    taken, want = set(), []
    for a, b in matches:
        if not {a, b} & taken:
            taken |= {a, b}
            want.append((a, b))
    got = sorted((x.first, x.second) for x in pairs.offer_pairs(df, "ord").collect() if x.second is not None)
    assert want and got == want


def test_alias_tables_are_parameters(spark):
    df = spark.createDataFrame([("1", "SSD Acme 870 EVO 500GB")], "id string, title string")
    assert storage.canonical(df).first().brand is None and storage.canonical(df, brands=(*storage.BRANDS, ("acme", "ACME"))).first().brand == "ACME"


def test_catalogue_comparison_never_broadcasts_the_listings(spark, rows, tmp_path, monkeypatch):
    """Their files are small enough for Spark to broadcast them; only the counted, judged devices may be."""
    spark.range(300).select(F.col("id").alias("p_partkey"), (900 + F.col("id") % 7 * 0.5).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    every = storage.canonical(listings(spark, str(tmp_path)).select("listing_id", "title")).withColumn("item", F.col("listing_id"))
    alone = pairs.against(every, listing_queries._catalogue(spark), ["item"])
    want = rows(alone.select(F.col("l_item").alias("listing_id"), F.col("r_item").alias("item"), "verdict", "confidence", *[F.col(f"status.{f}").alias(f"is_{f}") for f in compare.FIELDS]))
    for most, join in ((pairs.BROADCAST_ROWS, "BroadcastHashJoin"), (100, "SortMergeJoin")):
        monkeypatch.setattr(pairs, "BROADCAST_ROWS", most)
        got = listing_queries.compare_catalogue(spark, str(tmp_path))
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert join in plan and "BuildLeft" not in plan
        assert rows(got) == want and len(want) == 900 * len(listing_queries.CATALOGUE)
