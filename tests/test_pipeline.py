from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from garimpo.plans import connectors, pipeline
from garimpo.sources.store import SCHEMAS, Store
from garimpo.streaming import ingest

SCHEMA = "title string, price double, price_text string, url string, source string, ord bigint"


def shop(spark, *rows):
    return lambda query: spark.createDataFrame(list(rows), SCHEMA)


def test_search_many_survives_failures(spark):
    def broken(query):
        raise TimeoutError("no answer")

    a = shop(spark, ("SSD Samsung 870 EVO 500GB", 1.0, "R$ 1", "u1", None, 1), ("", None, None, "u2", None, 2))
    b = shop(spark, ("SSD Samsung 870 EVO 500GB", 1.0, "R$ 1", "u1", "b", 1), ("Cadeira", 2.0, None, "u3", None, 2))
    got = pipeline.search_many("ssd", {"a": a, "b": b, "c": broken})
    assert got.errors == {"c": "no answer"} and not got.all_failed
    assert sorted(r.provider for r in got.products.collect()) == ["a", "a", "b"]
    assert got.canonical.count() == 4
    assert pipeline.search_many("ssd", {"a": a, "b": b}, query_filter=True).products.count() == 1
    assert pipeline.search_many("ssd", {"c": broken}).all_failed and pipeline.search_many("ssd", {}).all_failed
    with pytest.raises(ValueError, match="unknown"):
        pipeline.search_many("ssd", {"a": a}, providers=["z"])


def test_search_compares(spark):
    a = shop(spark, ("SSD Kingston A400 480GB SATA", None, "R$ 10,00", "u1", None, 1))
    one = pipeline.search("a400", "a", a)
    got = pipeline.search("a400", "a", a, compare_with=one.canonical)
    assert got.comparisons.first().verdict == "IDENTICAL" and got.normalized.first().current_price == 10.0
    with pytest.raises(ValueError, match="non-empty"):
        pipeline.search("", "a", a)


def test_a_search_is_stored(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("SSD Kingston A400 480GB SATA", None, "R$ 1.010,00", "u1", None, 1)], SCHEMA)
    found = pipeline.search("a400", "a", lambda q: pipeline.Page(rows, "https://a.example/?q=" + q, {"currentPage": 1}, 7), store=s)
    empty = pipeline.search("a400", "a", lambda q: rows.limit(0), store=s)
    broken = pipeline.search("a400", "b", lambda q: rows.withColumn("title", F.raise_error(F.lit("gone")).cast("string")), store=s)
    assert "gone" in broken.errors["b"] and broken.all_failed and found.products.count() == 1
    got = {r.id: (r.provider, r.status, r.productCount, r.url) for r in s.read("searches").collect()}
    assert got == {found.search_id: ("a", "success", 1, "https://a.example/?q=a400"), empty.search_id: ("a", "partial", 0, ""), broken.search_id: ("b", "failed", 0, "")}
    one = s.search(found.search_id).first()
    assert one.executionTime == 7 and one.pagination == '{"currentPage": 1}' and one.raw[0].price == 1010.0 and one.raw[0].source == "raw"
    assert one.normalized[0].brand == "Kingston" and one.normalized[0].currentPrice == 1010.0
    assert s.counts().first().products == 2


def test_search_many_reports_each_source(spark):
    a = shop(spark, ("SSD Samsung 870 EVO 500GB", 1.0, "R$ 1", "u1", None, 1), ("Cadeira", 2.0, None, "u3", None, 2))
    late = lambda q: a(q).withColumn("title", F.raise_error(F.lit("broke while read")).cast("string"))
    got = pipeline.search_many("ssd", {"a": lambda q: pipeline.Page(a(q), "https://a", {"currentPage": 2}), "b": a, "c": late}, query_filter=True)
    assert got.providers == [{"provider": "a", "success": True, "productCount": 2, "url": "https://a", "pagination": {"currentPage": 2}}, {"provider": "b", "success": True, "productCount": 2, "url": "", "pagination": None}]
    assert "broke while read" in got.errors["c"]
    assert got.counts() == {"providerCount": 3, "successfulCount": 2, "failedCount": 1, "productCount": 1, "filteredCount": 2}
    assert got.view("raw")["normalized"] is None and got.view("normalized")["products"] is got.normalized and got.view()["products"] is got.products


def test_connectors_read_captured_pages(spark):
    marked = '<a data-cy="list-product" href="/p/1"><h2>SSD A400</h2><span class="price">R$ 10,00</span></a><a href="/busca?page=2">2</a><a href="/busca?page=3">3</a>'
    plain = '<a href="/produto/1/x">SSD Kingston A400 480GB <span>R$ 10,00</span></a><a href="/b?page_number=2">2</a>'
    button = '<li class="andes-pagination__button{0}"><a>{1}</a></li>'
    listed = '<li class="ui-search-layout__item"><h2>SSD A400</h2><a href="https://ml.example/p1">x</a><span class="price">R$ 10</span></li>' + button.format("", 1) + button.format(" andes-pagination__button--current", 2) + button.format(" andes-pagination__button--next", "")
    schema = "query string, page int, url string, html string"
    df = lambda html: spark.createDataFrame([("ssd", 1, "https://s.example/busca", html), ("ssd", 2, "https://s.example/busca?page=2&page_number=2", html)], schema)
    one = connectors.marked_shop("s", "https://s.example/", df(marked)).search("ssd")
    assert [(r.title, r.price, r.url, r.source) for r in one.rows.collect()] == [("SSD A400", 10.0, "https://s.example/p/1", "s")]
    assert one.pagination == {"currentPage": 1, "pages": [2, 3], "nextPageUrl": "https://s.example/busca?page=2", "hasNextPage": True}
    two = connectors.plain_shop("s", "https://s.example/", df(plain)).search("ssd", 2)
    assert two.pagination == {"currentPage": 2, "pages": [2], "nextPageUrl": None, "hasNextPage": False} and two.rows.count() == 1
    shop = connectors.listed_shop("s", "https://ml.example/", df(listed), "ml.example", "https://lista.example/")
    got = shop.search("ssd")
    assert got.pagination == {"currentPage": 2, "pages": [1, 2], "nextPageUrl": "https://lista.example/ssd_Desde_97_NoIndex_True", "hasNextPage": True}
    assert shop.search("hd").rows.count() == 0 and shop.search("hd").pagination is None
    with pytest.raises(ValueError, match="non-empty"):
        shop.search(" ")
    many = pipeline.search_many("ssd", {"m": connectors.marked_shop("m", "https://s.example/", df(marked)), "l": shop})
    assert many.products.count() == 2 and many.providers[1]["pagination"]["hasNextPage"]
    none = connectors.button_pagination(F.col("html"), lambda n: n.cast("string"))
    assert df("<p>").select(none.alias("p")).first().p.asDict() == {"currentPage": 1, "pages": [1], "nextPageUrl": None, "hasNextPage": False}
    checked = spark.sql("SELECT named_struct('currentPage', 1, 'pages', array(1), 'hasNextPage', true) AS p UNION ALL SELECT named_struct('currentPage', 1, 'pages', array(), 'hasNextPage', true) UNION ALL SELECT NULL")
    assert [r.ok for r in checked.select(connectors.valid_pagination(F.col("p"), F.lit(1)).alias("ok")).collect()] == [True, False, False]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.counts().first().products == 0 and s.search("1").count() == 0
    s.add_searches(spark.createDataFrame([("1", 0)], "id string, executionTime int"))
    s.add_raw(spark.createDataFrame([("1", "p", "t", "R$ 5,00")], "searchId string, provider string, title string, priceText string"))
    s.add_normalized(spark.createDataFrame([("1", "p", 1)], "searchId string, provider string, obsolete int"), null_price_as_zero=True)
    r = s.search("1").first()
    assert r.executionTime is None and r.status == "success" and r.raw[0].price == 5.0 and r.normalized[0].currentPrice == 0.0
    assert s.counts().first().asDict() == {"searches": 1, "raw": 1, "normalized": 1, "products": 2}
    assert s.read("normalized_products").columns == [c.split()[0] for c in SCHEMAS["normalized_products"].split(", ")]
    with pytest.raises(Exception, match="needs an id"):
        s.add_searches(spark.createDataFrame([(None,)], "id string"))


def test_stream_drops_repetitions(spark, tmp_path):
    schema = "provider string, url string, title string, price double, pricetext string, createdat timestamp"
    row = "SELECT 'p' AS provider, 'u' AS url, 'SSD Samsung' AS title, CAST(NULL AS DOUBLE) AS price, 'R$ 7,00' AS pricetext, timestamp'2020-01-01 00:00:00' AS createdat"
    spark.sql(f"{row} UNION ALL {row}").write.parquet(str(tmp_path / "in"))
    stream = ingest.with_attributes(ingest.deduplicated(ingest.listing_stream(spark, str(tmp_path / "in"), schema)))
    ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.brand, r.currentprice) for r in got] == [("Samsung", 7.0)]


def test_entry_has_every_oracle():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_absolute_urls(spark):
    from garimpo.functions.urls import absolute_url

    df = spark.createDataFrame([("http://a/b",), ("/x",), ("y",), ("//h/z",)], "u string").select(absolute_url(F.col("u"), "https://s.example/").alias("u"))
    assert [r.u for r in df.collect()] == ["http://a/b", "https://s.example/x", "https://s.example/y", "https://h/z"]
