"""Queries of the listing operators over whole tables, each with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import failures, prices, relevance, storage, titles, urls
from garimpo.operators import compare, dedup, pairs, statistics
from garimpo.plans import connectors, pipeline
from garimpo.plans.listing_sql import build
from garimpo.session import cut
from garimpo.sources import pages, store
from garimpo.sources.listings import listings
from garimpo.sources.tables import table

QUERY = "ssd kingston a400 480gb"
CATALOGUE = (
    (1, "SSD Samsung 990 PRO 2TB M.2 PCIe Gen4 NVMe"), (2, "SSD Kingston A400 480GB SATA"), (3, "SSD WD Blue SN580 1TB NVMe M.2"), (4, "SSD Corsair MP600 1TB PCIe Gen4 NVMe"),
    (5, "SSD Samsung 870 EVO 500GB 2.5\" SATA III"), (6, "SSD Crucial MX500 1TB 2.5\" SATA"), (7, "SSD Lexar NM790 2TB PCIe 4.0 NVMe"), (8, "SSD XPG SX8200 Pro 1TB PCIe Gen3x4"),
    (9, "Kingston SV300S37/480G"), (10, "SSD Western Digital Black SN850X 2TB NVMe"), (11, "SSD NVMe 500GB"), (12, "Corsair Force MP510 960G M2 2280"),
)
MESSAGES = (
    "Timeout 30000ms exceeded", "net::ERR_CONNECTION_RESET", "Cloudflare challenge (403)", "connect ECONNREFUSED 127.0.0.1", "Element not found: selector .card",
    "Navigation failed because page crashed", "Cannot read properties of undefined", "Service temporary unavailable, try again", "DNS lookup failed", "Error: boom", "HTTP 429 rate limit", "strange",
)
CATEGORIES = ("cloudflare", "timeout", "navigation", "selector", "network_dns", "other")


def _texts(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _raw(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """raw_products with each id once (deliveries repeat whole rows)."""
    return table(spark, d, "raw_products", "id", *columns).dropDuplicates(["id"])


def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "normalized_products", "id", "originaltitle").select("id", titles.clean_title(F.col("originaltitle")).alias("title"))


def title_attributes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return listings(spark, d).select(
        "listing_id", titles.clean_title(t).alias("clean"), titles.brand(t).alias("brand"), titles.storage_capacity(t).alias("storage"), titles.memory_capacity(t).alias("memory"),
        titles.availability(t, F.col("price_text"), F.col("provider")).alias("availability"),
    )


def title_models(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("listing_id", titles.model(F.col("title")).alias("model"))


def listing_capacities(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("originaltitle")
    df = table(spark, d, "normalized_products", "id", "originaltitle", "pricetext", "provider")
    return df.select("id", titles.storage_capacity(t).alias("storage"), titles.memory_capacity(t).alias("memory"), titles.availability(t, F.col("pricetext"), F.col("provider")).alias("availability"))


def parsed_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices as the shop readers and the store read them."""
    x = F.col("pricetext")
    return _raw(spark, d, "pricetext").select("id", prices.parse_price(x).alias("parsed"), prices.stored_price(x).alias("stored"))


def listing_prices(spark: SparkSession, d: str) -> DataFrame:
    p, x = F.col("price"), F.col("pricetext")
    return _raw(spark, d, "price", "pricetext").select("id", prices.current_price(p, x).alias("current"), prices.original_price(p, x).alias("original"), prices.format_brl(F.col("price")).alias("shown"))


def canonical_devices(spark: SparkSession, d: str) -> DataFrame:
    df = storage.canonical(listings(spark, d).select("listing_id", "title"))
    return df.select("listing_id", *storage.FACTS, *[F.col(f"confidence.{c}").alias(f"conf_{c}") for c in (*storage.CONFIDENCES, "overall")])


def flat_devices(spark: SparkSession, d: str) -> DataFrame:
    df = storage.flat(storage.canonical(listings(spark, d).select("listing_id", "title")))
    return df.select("listing_id", "brand", "model", "family", "capacity", "capacityUnit", "overall")


def _devices(spark: SparkSession, d: str) -> DataFrame:
    return storage.canonical(listings(spark, d).select("listing_id", "provider", "title"))


def _catalogue(spark: SparkSession) -> DataFrame:
    return storage.canonical(_texts(spark, CATALOGUE, "item int, title string"))


def _against_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Every different device with every catalogue row."""
    distinct = pairs.distinct_devices(_devices(spark, d), "listing_id").withColumn("item", F.col("first"))
    return pairs.against(distinct, _catalogue(spark), ["item"])


def compare_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with every catalogue row; equal devices are compared once and joined back.

    The listings are never broadcast: repeated facts make their files so small that Spark would, for any number of rows.
    """
    devices = cut(_devices(spark, d))  # read once for the comparison and once to join back
    distinct = cut(pairs.distinct_devices(devices, "listing_id").withColumn("item", F.col("first")))  # read for the count as well
    judged = pairs.against(distinct, _catalogue(spark), ["item"])
    devices = devices.select("listing_id", F.struct(*compare.INPUTS).alias("l"))
    if pairs.is_small(judged):
        judged = F.broadcast(judged)
    else:
        devices = devices.hint("merge")
    same = reduce(lambda a, b: a & b, [F.col(f"a.l.{c}").eqNullSafe(F.col(f"b.l.{c}")) for c in compare.INPUTS])
    fields = [F.col(f"b.status.{f}").alias(f"is_{f}") for f in compare.FIELDS]
    return devices.alias("a").join(judged.alias("b"), same).select("a.listing_id", F.col("b.r_item").alias("item"), "b.verdict", "b.confidence", *fields)


def compare_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of different devices once."""
    df = pairs.distinct_devices(_devices(spark, d), "listing_id")
    return pairs.each_with_each(df, "first", ["n"]).select(F.col("l_first").alias("first"), F.col("r_first").alias("second"), "verdict", "confidence")


def matching_devices(spark: SparkSession, d: str) -> DataFrame:
    """The matching ones of these pairs, found without comparing all of them."""
    df = pairs.distinct_devices(_devices(spark, d), "listing_id")
    return pairs.matching(df, "first", ["n"]).select(F.col("l_first").alias("first"), F.col("r_first").alias("second"), "verdict", "confidence", (F.col("l_n") * F.col("r_n")).alias("listing_pairs"))


def comparison_reports(spark: SparkSession, d: str) -> DataFrame:
    df = _against_catalogue(spark, d).withColumn("rows", compare.reasons())
    return df.select(F.col("l_item").alias("first"), F.col("r_item").alias("item"), compare.report(F.col("verdict"), F.col("confidence"), F.col("rows")).alias("report"))


def field_matchers(spark: SparkSession, d: str) -> DataFrame:
    """The older matchers, field by field."""
    df = pairs.against(pairs.distinct_devices(_devices(spark, d), "listing_id").withColumn("item", F.col("first")), _catalogue(spark), ["item"])
    return df.withColumn("m", compare.legacy_matches()).select(F.col("l_item").alias("first"), F.col("r_item").alias("item"), "m.*")


def greedy_offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers of two different devices that match, and devices left alone."""
    return pairs.offer_pairs(pairs.distinct_devices(_devices(spark, d), "listing_id"), "first")


def product_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of normalized_products read from its title and price text again."""
    df = table(spark, d, "normalized_products", "id", "provider", "originaltitle", "pricetext", "url")
    df = df.select("provider", F.col("originaltitle").alias("title"), F.lit(None).cast("double").alias("price"), F.col("pricetext").alias("price_text"), "url", F.col("id").alias("ord"))
    return pipeline.normalized(df).select(F.col("ord").alias("id"), "normalized_title", "brand", "model", "storage_capacity", "memory_capacity", "currency", "current_price", "original_price", "availability", "confidence")


def _product_devices(spark: SparkSession, d: str) -> DataFrame:
    return storage.canonical(table(spark, d, "normalized_products", "id", "originaltitle").withColumnRenamed("originaltitle", "title"))


def product_devices(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every row of normalized_products."""
    return _product_devices(spark, d).select("id", *compare.INPUTS)


def warranty_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Different devices of normalized_products with the warranty their titles state, against a catalogue with warranties."""
    t = F.lower("title")
    n, unit = F.regexp_extract(t, r"garantia (?:de )?(\d{1,2}) (?:anos?|mes|mês)", 1), F.regexp_extract(t, r"garantia (?:de )?\d{1,2} (anos?|mes|mês)", 1)
    months = F.when(n != "", n.try_cast("int") * F.when(unit.startswith("ano"), 12).otherwise(1))
    df = _product_devices(spark, d).withColumn("warranty", months).groupBy(*compare.INPUTS, "warranty").agg(F.min("id").alias("item"))
    catalogue = _catalogue(spark).withColumn("warranty", (F.col("item") % 4 * 12).cast("int"))
    return pairs.against(df, catalogue, ["item"]).select(F.col("l_item").alias("first"), F.col("r_item").alias("item"), "verdict", "confidence", F.col("status.warranty").alias("is_warranty"))


def match_quality(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts against the catalogue, taking equal brand, model and capacity as the truth.

    Each different device counts once, however many listings show it, as in the SQL; these are not rates of listings.
    """
    same = F.col("l.brand").eqNullSafe(F.col("r.brand")) & F.col("l.model").eqNullSafe(F.col("r.model")) & F.col("l.capacityGB").eqNullSafe(F.col("r.capacityGB"))
    return statistics.confusion(_against_catalogue(spark, d), F.col("verdict").isin("IDENTICAL", "LIKELY_IDENTICAL"), same)


def _for_query(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return listings(spark, d).select("listing_id", titles.clean_title(t).alias("title"), titles.brand(t).alias("brand"), titles.model(t).alias("model"))


def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    df = relevance.scored(_for_query(spark, d), QUERY)
    return df.select("listing_id", "score", F.array_join("matched", " ").alias("matched"), F.array_join("unmatched", " ").alias("unmatched"))


def relevant_listings(spark: SparkSession, d: str) -> DataFrame:
    return relevance.relevant(_for_query(spark, d), QUERY, 0.6).select("listing_id", "title", "score")


def search_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What a relevance filter keeps."""
    df = relevance.scored(_for_query(spark, d), QUERY)
    kept = F.count_if(F.col("score") >= relevance.DEFAULT_THRESHOLD)
    return df.agg(F.count("*").alias("total"), kept.alias("kept"), (F.count("*") - kept).alias("filtered"))


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    df = listings(spark, d).withColumn("source", F.when(F.col("listing_id") % 2 == 0, F.col("provider")))
    return dedup.dedup_listings(df, "listing_id").select("listing_id", "title", "provider", "url")


def raw_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    df = _raw(spark, d, "provider", "title", "url", "source")
    return dedup.dedup_listings(df, "id").select("id")


def first_titles(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_by_title(listings(spark, d), "listing_id").select("listing_id", "title", "url")


def shop_listings(spark: SparkSession, d: str) -> DataFrame:
    """Cards of one shop to listings: absolute addresses, prices, first titles."""
    df = listings(spark, d).filter(F.col("provider") == "kabum").select("listing_id", "title", "price_text", F.regexp_replace("url", r"^https://[^/]+", "").alias("url"))
    return pipeline.shop_listings(df, "https://kabum.example/", "kabum", "listing_id").select("listing_id", "title", "price", "url", "source")


def provider_union(spark: SparkSession, d: str) -> DataFrame:
    df = listings(spark, d)
    parts = [pipeline.with_provider(df.filter(F.col("provider") == p).withColumn("provider", F.lit(None if p == "kabum" else "").cast("string")).withColumn("source", F.lit(p if p != "pichau" else "")), p) for p in ("pichau", "kabum", "mercadolivre")]
    return reduce(DataFrame.unionByName, parts).select("listing_id", "provider", "title")


def provider_summary(spark: SparkSession, d: str) -> DataFrame:
    df = listings(spark, d).withColumn("price", prices.parse_price(F.col("price_text")))
    return pipeline.provider_summary(df)


def brand_prices(spark: SparkSession, d: str) -> DataFrame:
    df = _devices(spark, d).join(listings(spark, d).select("listing_id", prices.parse_price(F.col("price_text")).alias("price")), "listing_id")
    return df.groupBy("provider", "brand").agg(F.count("*").alias("listings"), F.min("price").alias("least"))


def listing_validity(spark: SparkSession, d: str) -> DataFrame:
    return statistics.validity(_raw(spark, d, "provider", "price", "title", "url"), "provider", "price", "title", "url")


def page_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Titles that two shops don't share."""
    df = listings(spark, d)
    of = lambda p: df.filter(F.col("provider") == p).select("title").distinct()
    return dedup.missing_between(of("pichau"), of("mercadolivre"))


def _ok():  # noqa: ANN202
    return F.coalesce(F.col("status") == "success", F.lit(False))


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return statistics.run_statistics(table(spark, d, "searches", "provider", "status", "executiontime", "productcount"), ["provider"], "executiontime", "productcount", _ok())


def query_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "searches", "provider", "searchquery", "status", "executiontime", "productcount").withColumn("query", F.lower(F.trim("searchquery")))
    return statistics.run_statistics(df, ["provider", "query"], "executiontime", "productcount", _ok()).select("provider", "query", "runs", "min_ms", "max_ms", "avg_ms")


def page_success(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "searches", "provider", "status", "pagination").withColumn("page", F.get_json_object("pagination", "$.currentPage").try_cast("int"))
    return df.groupBy("provider", "page").agg(F.count("*").alias("runs"), F.count_if(_ok()).alias("successes"))


def engine_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value of two kinds of events per user, and their difference."""
    df = table(spark, d, "events", "user_id", "event_type", "value").filter(F.col("event_type").isin("view", "click"))
    # Exact sums of hundredths: a mean of doubles would depend on the order in which partitions are added up.
    cents = F.floor(F.col("value") * F.lit(100.0) + F.lit(0.5)).cast("long")
    of = lambda k: F.sum(F.when(F.col("event_type") == k, cents)).cast("double") / F.nullif(F.count_if(F.col("event_type") == k), F.lit(0)) / F.lit(100.0)
    return df.groupBy("user_id").agg(of("view").alias("view"), of("click").alias("click")).withColumn("delta", F.col("click") - F.col("view"))


def _failures(spark: SparkSession, d: str) -> DataFrame:
    messages = F.array(*[F.lit(m) for m in MESSAGES])
    names = F.array(*[F.lit(n) for n in ("Error", "TimeoutError", "TypeError")])
    df = table(spark, d, "events", "event_id", "user_id", "event_type", "ts").filter(F.col("event_type") == "error")
    return df.withColumns({"message": F.get(messages, (F.col("event_id") % len(MESSAGES)).cast("int")), "name": F.get(names, (F.col("event_id") % 3).cast("int"))})


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    m, n = F.col("message"), F.col("name")
    attempt = (F.col("event_id") % 5).cast("int")
    df = _failures(spark, d).withColumn("kind", failures.failure_class(m, n))
    return df.select("event_id", "kind", failures.failure_category(m, n).alias("category"), failures.should_retry(F.col("kind"), attempt).alias("retry"), failures.retry_delay(attempt).alias("delay_ms"))


def failure_pivot(spark: SparkSession, d: str) -> DataFrame:
    df = _failures(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return statistics.pivot_counts(df, "day", failures.failure_category(F.col("message"), F.col("name")), list(CATEGORIES))


def failure_distribution(spark: SparkSession, d: str) -> DataFrame:
    df = _failures(spark, d).groupBy(failures.failure_category(F.col("message"), F.col("name")).alias("category")).agg(F.count("*").alias("n"))
    return df.orderBy(F.desc("n"), "category")


def search_urls(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "searches", "id", "searchquery", "productcount")
    page = (F.col("productcount") % 4).cast("int")
    return df.select("id", urls.search_slug(F.col("searchquery")).alias("slug"), urls.search_page_url("https://lista.example/", F.col("searchquery"), page).alias("url"))


def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pagination read from the links of a result page."""
    df = table(spark, d, "searches", "id", "url", "productcount").filter(F.col("url").isNotNull())
    n = F.coalesce(F.col("productcount"), F.lit(0))
    link = lambda p: F.concat("url", F.lit("&page="), (n % 7 + p).cast("string"))
    df = df.withColumns({"links": F.array(link(3), link(0), link(1), link(3), F.concat("url", F.lit("&page=x")), F.col("url")), "here": F.when(n % 3 == 0, F.col("url")).otherwise(link(1))})
    return df.select("id", urls.pagination(F.col("links"), F.col("here"), "page").alias("p")).select("id", "p.currentPage", F.array_join("p.pages", ",").alias("pages"), "p.nextPageUrl", "p.hasNextPage")


def _page_html(spark: SparkSession, d: str) -> DataFrame:
    """Result pages of forty listings each, as a shop would render them."""
    t = F.concat(F.lit('<div><a data-cy="list-product" href="'), F.coalesce("url", F.lit("")), F.lit('"><h2> '), "title", F.lit(' </h2><span class="price_vista">'), "price_text", F.lit("</span></a></div>"))
    df = listings(spark, d).filter(F.col("provider") == "pichau").withColumn("page", F.floor(F.col("k") / 40).cast("long"))
    return df.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", t.alias("t")))), lambda x: x["t"]), "\n").alias("html"))


def page_cards(spark: SparkSession, d: str) -> DataFrame:
    df = pages.marked_cards(_page_html(spark, d), keep=["page"])
    return df.select("page", "pos", "title", "price_text", "url")


def _pages_of(spark: SparkSession, d: str, provider: str, per_page: int, card) -> DataFrame:  # noqa: ANN001
    """(page, html): result pages of a shop, `per_page` cards each in the order of k."""
    df = listings(spark, d).filter(F.col("provider") == provider).withColumn("page", F.floor(F.col("k") / per_page).cast("long"))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("k", card.alias("card")))), lambda x: x["card"])
    return df.groupBy("page").agg(F.array_join(cards, "\n").alias("html"))


def plain_page_cards(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a hundred cards in the layout that keeps everything in one text; eighty of each are read."""
    card = F.concat(F.lit('<a href="/produto/'), F.col("k").cast("string"), F.lit('/x"><div>Avaliação 4.5 de 5</div><div>'), "title", F.lit("</div> <b>"), "price_text", F.lit("</b><br>em 10x de R$ 9,90</a>"))
    return pages.plain_cards(_pages_of(spark, d, "kabum", 100, card), "page").select("page", "pos", "title", "price_text", "url")


def listed_page_cards(spark: SparkSession, d: str) -> DataFrame:
    """Pages in the layout of a result list, with advertisements, click counters and links to other shops."""
    ad = F.when(F.col("k") % 10 == 0, '<div class="ui-search-item__ad">').otherwise("<div>")
    card = F.concat(F.lit('<li class="ui-search-layout__item">'), ad, F.lit('<h2> '), "title", F.lit(' </h2><a href="https://click1.mercadolivre.example/x">+</a><a href="'), "url", F.lit('">+</a><span class="price">'), "price_text", F.lit("</span></div></li>"))
    return pages.listed_cards(_pages_of(spark, d, "mercadolivre", 48, card), "mercadolivre.example", keep=["page"]).select("page", "pos", "title", "price_text", "url")


def page_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of failed and empty result pages, and whether the page is an access check by its title."""
    df = _failures(spark, d).withColumn("message", F.when(F.col("event_id") % 4 != 0, F.col("message")))
    cards = (F.col("event_id") % 8 / 4).cast("int")
    title = F.when(F.col("event_id") % 5 == 0, F.lit("Loja em Manutenção")).when(F.col("event_id") % 5 == 1, F.lit("SSD"))
    return df.select("event_id", failures.page_code(F.col("message"), F.col("name"), cards).alias("code"), failures.is_blocked(title).alias("blocked"), failures.label(F.col("message"), F.col("name")).alias("label"))


def search_products(spark: SparkSession, d: str) -> DataFrame:
    """Every search with its raw and normalized rows, as a store gives them back."""
    raw = _raw(spark, d, "searchid", "title")
    np = table(spark, d, "normalized_products", "id", "searchid", "brand")
    df = store.with_products(table(spark, d, "searches", "id", "status"), raw, np, "id", "searchid")
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    return df.select("id", "status", ids("raw").alias("raw"), ids("normalized").alias("normalized"), F.get("normalized", F.lit(0))["brand"].alias("first_brand"))


def page_validity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pagination stored with each search is complete, and the expected page where the product count names one."""
    p = F.from_json("pagination", "currentPage int, pages array<int>, nextPageUrl string, hasNextPage boolean")
    df = table(spark, d, "searches", "id", "pagination").withColumn("p", p)
    return df.select("id", connectors.valid_pagination(F.col("p")).alias("valid"), connectors.valid_pagination(F.col("p"), F.lit(1)).alias("first_page"))


def search_rows(spark: SparkSession, d: str) -> DataFrame:
    """Searches with the numbers of their rows."""
    s = table(spark, d, "searches", "id", "provider", "status")
    raw = _raw(spark, d, "searchid").groupBy("searchid").agg(F.count("*").alias("raw"))
    np = table(spark, d, "normalized_products", "searchid").groupBy("searchid").agg(F.count("*").alias("normalized"))
    return s.join(raw, s.id == raw.searchid, "left").drop("searchid").join(np, s.id == np.searchid, "left").drop("searchid").fillna(0, ["raw", "normalized"])


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.table_counts({"searches": table(spark, d, "searches", "id"), "raw_products": table(spark, d, "raw_products", "id"), "normalized_products": table(spark, d, "normalized_products", "id")})


def search_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether a search found rows, and the time it took."""
    df = search_rows(spark, d).select("id", F.when(F.col("raw") > 0, "success").otherwise("partial").alias("state"))
    return df.join(table(spark, d, "searches", "id", "executiontime"), "id").select("id", "state", prices.format_ms(F.col("executiontime")).alias("took"))


def listing_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: listings and least price by provider and brand with subtotals."""
    df = _devices(spark, d).join(listings(spark, d).select("listing_id", prices.parse_price(F.col("price_text")).alias("price")), "listing_id")
    return df.rollup("provider", "brand").agg(F.grouping_id().alias("level"), F.count("*").alias("listings"), F.min("price").alias("least"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_titles, title_attributes, title_models, listing_capacities, parsed_prices, listing_prices, canonical_devices, flat_devices, compare_catalogue, compare_distinct,
        matching_devices, comparison_reports, field_matchers, greedy_offers, match_quality, product_rows, product_devices, warranty_pairs, relevance_scores, relevant_listings, search_statistics, deduplicated, raw_deduplicated,
        first_titles, shop_listings, provider_union, provider_summary, brand_prices, listing_validity, page_overlap, run_statistics, query_statistics, page_success, engine_deltas,
        failure_classes, failure_pivot, failure_distribution, search_urls, search_pages, page_cards, plain_page_cards, listed_page_cards, page_codes, page_validity, search_products, search_rows, table_counts, search_states, listing_rollup,
    )
}
SQL: dict[str, str] = build(CATALOGUE, MESSAGES, QUERY, CATEGORIES)
