"""Queries of the general data problems: history of prices, quantities in common units."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators import history, units
from garimpo.session import cut
from garimpo.sources.tables import table

LISTING = ["provider", "providerproductid"]


def _prices(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_products", "id", *LISTING, "price", "createdat")
    return df.filter(F.col("price").isNotNull() & (F.col("price") != 0) & F.col("providerproductid").isNotNull())


def price_satellite(spark: SparkSession, d: str) -> DataFrame:
    return history.changes(_prices(spark, d), LISTING, ["price"], "createdat", ["id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return price_satellite(spark, d).select(*LISTING, F.unix_micros("valid_from").alias("validfrom_us"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    df = history.periods(price_satellite(spark, d), LISTING, ["id"])
    return df.select(*LISTING, "price", F.unix_micros("valid_from").alias("validfrom_us"), F.unix_micros("valid_to").alias("validto_us"))


def p1_change_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each attribute of a listing changes; what splits them into satellites."""
    return history.change_rates(_observed(spark, d), LISTING, ATTRIBUTES, "createdat", ["id"])


#: Attributes of a listing that are kept in satellites.
ATTRIBUTES = ["title", "pricetext", "price", "url", "source"]
#: Deliveries in which p1_appended takes the rows.
DELIVERIES = 3


def _observed(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "raw_products", "id", *LISTING, *ATTRIBUTES, "createdat")
    return df.dropDuplicates(["id"]).filter(F.col("providerproductid").isNotNull())


def p1_satellites(spark: SparkSession, d: str) -> DataFrame:
    """Versions in the satellites of all attributes, which are split into fast and slow ones by their measured rate of change."""
    df = cut(_observed(spark, d))
    rates = {r.attribute: r.rate for r in history.change_rates(df, LISTING, ATTRIBUTES, "createdat", ["id"]).collect()}  # one row an attribute
    split = zip(("fast", "slow"), history.split_by_rate(rates), strict=True)
    parts = [history.changes(df, LISTING, names, "createdat", ["id"]).select(*LISTING, F.lit(kind).alias("satellite"), F.unix_micros("valid_from").alias("validfrom_us")) for kind, names in split if names]
    return reduce(DataFrame.unionByName, parts) if parts else df.select(*LISTING, F.lit("slow").alias("satellite"), F.unix_micros("createdat").alias("validfrom_us")).limit(0)


def p1_appended(spark: SparkSession, d: str) -> DataFrame:
    """The price versions once more, from a satellite to which the rows are appended delivery by delivery as they arrive."""
    df = _prices(spark, d).withColumn("n", F.regexp_extract("id", r"(\d+)$", 1).try_cast("long"))
    low, high = df.agg(F.min("n"), F.max("n")).first()
    low, high = low or 0, high or 0
    ends = [low + (high - low + 1) * k // DELIVERIES for k in range(1, DELIVERIES + 1)]
    satellite, began = None, None
    for end in ends:
        batch = df.filter(F.coalesce("n", F.lit(low)) < end)
        if satellite is None:
            satellite = cut(history.changes(batch, LISTING, ["price"], "createdat", ["id"]))
        else:
            seen = df.filter(F.coalesce("n", F.lit(low)) < began)
            new = history.append(satellite, batch.filter(F.coalesce("n", F.lit(low)) >= began), seen, LISTING, ["price"], "createdat", ["id"])
            satellite = cut(satellite.unionByName(new))
        began = end
    df = history.periods(satellite, LISTING, ["id"])
    return df.select(*LISTING, F.unix_micros("valid_from").alias("validfrom_us"))


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    np = table(spark, d, "normalized_products", "id", "originaltitle", "storagecapacity", "memorycapacity")
    np_fields = [(c, units.capacity(F.col(c), F.col("originaltitle")), units.USUAL_CAPACITY) for c in ("storagecapacity", "memorycapacity")]
    rp = table(spark, d, "raw_products", "id", "pricetext", "price")
    rp_fields = [("pricetext", units.price(F.col("pricetext"), F.col("price")), units.USUAL_PRICE)]
    return units.in_common_units(np, np_fields, "normalized_products").unionByName(units.in_common_units(rp, rp_fields, "raw_products"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d).select("tablename", "id", "field", "amount")


def p4_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field have a unique reading, and how many do not."""
    return _amounts(spark, d).groupBy("tablename", "field", "unique").agg(F.count("*").alias("n"))


def p4_flagged(spark: SparkSession, d: str) -> DataFrame:
    """The values whose reading isn't unique, or that contradict the columns beside them, with the reading taken."""
    return _amounts(spark, d).filter(~F.col("unique")).select("tablename", "id", "field", "amount")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_periods": p1_periods,
    "p1_change_rates": p1_change_rates,
    "p1_satellites": p1_satellites,
    "p1_appended": p1_appended,
    "p4_found": p4_found,
    "p4_ambiguous": p4_ambiguous,
    "p4_flagged": p4_flagged,
}

_OBSERVED = """
    SELECT DISTINCT id, provider, providerproductid, price, createdat FROM raw_products
    WHERE providerproductid IS NOT NULL AND price IS NOT NULL AND price <> 0"""
_VERSIONS = f"""
    SELECT * FROM (
      SELECT *, lag(price) OVER (PARTITION BY provider, providerproductid ORDER BY createdat, id) AS was,
             row_number() OVER (PARTITION BY provider, providerproductid ORDER BY createdat, id) AS rn
      FROM ({_OBSERVED}) o) w
    WHERE rn = 1 OR price <> was"""

_AMOUNTS = r"""
    WITH c AS (
      SELECT DISTINCT id, field, v, title FROM (SELECT id, 'storagecapacity' AS field, storagecapacity AS v, originaltitle AS title FROM normalized_products
        UNION ALL SELECT id, 'memorycapacity', memorycapacity, originaltitle FROM normalized_products) x WHERE v IS NOT NULL AND NOT regexp_full_match(v, '[0-9]+GB')),
    n AS (SELECT *, lower(translate(v, '×', 'x')) AS t, lower(title) AS tt FROM c),
    p AS (SELECT *,
        CASE WHEN regexp_matches(t, '[0-9] ?[a-z]+ ?\(') THEN 1 ELSE coalesce(try_cast(nullif(regexp_extract(t, '([0-9]+) ?(x|pentes de) ?[0-9]', 1), '') AS INT), try_cast(nullif(regexp_extract(t, 'b ?x ?([0-9]+)', 1), '') AS INT), 1) END AS k,
        CASE WHEN regexp_matches(t, '[0-9] ?[a-z]+ ?\(') THEN regexp_extract(t, '([0-9.,]+) ?[a-z]+ ?\(', 1) WHEN regexp_matches(t, '[0-9] ?(x|pentes de) ?[0-9]') THEN regexp_extract(t, '(x|pentes de) ?([0-9.,]+)', 2) ELSE regexp_extract(t, '[0-9]+([.,][0-9]+)*') END AS num,
        regexp_extract(t, '[0-9] ?([kmgt]i?b|gigas|gigabytes|tera|[gt])([^a-z]|$)', 1) AS u FROM n),
    q AS (SELECT *, CASE WHEN regexp_matches(num, '^[1-9][0-9]{0,2}[.][0-9]{3}$') THEN replace(num, '.', '')::DOUBLE ELSE try_cast(replace(num, ',', '.') AS DOUBLE) END AS x,
        CASE WHEN u = '' THEN CASE WHEN regexp_matches(tt, '(^|[^0-9.,])' || num || '([.,]0)? ?(tb|tera|t)([^a-z0-9/]|$)') THEN 1e12 WHEN regexp_matches(tt, '(^|[^0-9.,])' || num || ' ?(gb|g)([^a-z0-9/]|$)') THEN 1e9 WHEN regexp_matches(tt, '(^|[^0-9])' || num || '000 ?gb') THEN 1e12 END
             WHEN u = 'gib' THEN 1073741824 WHEN u = 'mib' THEN 1048576 WHEN u = 'tib' THEN 1099511627776 WHEN u[1] = 'm' THEN 1e6 WHEN u[1] = 'g' THEN 1e9 WHEN u[1] = 't' THEN 1e12 END::DOUBLE AS f FROM p),
    r AS (SELECT DISTINCT id, pricetext, lower(regexp_replace(translate(pricetext, '０１２３４５６７８９', '0123456789'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM raw_products
          WHERE pricetext IS NOT NULL AND NOT regexp_full_match(pricetext, 'R\$ [0-9]{1,3}([.][0-9]{3})*,[0-9]{2}')),
    s AS (SELECT *, CASE WHEN regexp_matches(t, ' por ') THEN regexp_extract(t, ' por .*') WHEN regexp_matches(t, ' ou [0-9]+x de') THEN regexp_extract(t, '^(.*) ou [0-9]', 1) ELSE t END AS a FROM r),
    z AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(a, '^([0-9]+)x de', 1), '') AS INT), 1) AS k, regexp_extract(regexp_replace(a, '^[0-9]+x de', ''), '[0-9]+([., ][0-9]+)*') AS num FROM s),
    y AS (SELECT *, CASE WHEN regexp_matches(num, '[.,][0-9]{1,2}$') THEN try_cast(regexp_replace(regexp_replace(num, '[.,]([0-9]{1,2})$', '_\1'), '[., ]', '', 'g').replace('_', '.') AS DOUBLE)
                         ELSE try_cast(regexp_replace(num, '[., ]', '', 'g') AS DOUBLE) END AS x FROM z)
    SELECT 'normalized_products' AS tablename, id, field, floor(x * k * f + 0.5)::BIGINT AS amount FROM q WHERE x IS NOT NULL AND f IS NOT NULL
    UNION ALL
    SELECT 'raw_products', id, 'pricetext', floor(CASE WHEN contains(t, 'reais e') THEN regexp_extract(t, '([0-9]+) reais', 1)::DOUBLE * 100 + regexp_extract(t, 'e ([0-9]+) centavos', 1)::DOUBLE WHEN contains(t, 'centavos') THEN x
             WHEN contains(t, ' mil') THEN x * 100000 ELSE x * k * 100 END + 0.5)::BIGINT FROM y WHERE x IS NOT NULL"""
#: Prices that one thousands mark leaves open, without a price column to decide.
_FLAGGED = rf"""
    SELECT DISTINCT a.* FROM ({_AMOUNTS}) a JOIN raw_products r ON a.tablename = 'raw_products' AND a.id = r.id
    WHERE coalesce(r.price, 0) = 0 AND regexp_matches(regexp_extract(translate(r.pricetext, '０１２３４５６７８９', '0123456789'), '[0-9]+([., ][0-9]+)*'), '^[1-9][0-9]{{0,2}}[.][0-9]{{3}}$')"""

_STEPS = """
    WITH one AS (SELECT DISTINCT id, provider, providerproductid, title, pricetext, price, url, source, createdat FROM raw_products WHERE providerproductid IS NOT NULL),
    n AS (SELECT *, lag(title) OVER w AS t0, lag(pricetext) OVER w AS x0, lag(price) OVER w AS p0, lag(url) OVER w AS u0, lag(source) OVER w AS s0,
                 row_number() OVER w AS rn
          FROM one WINDOW w AS (PARTITION BY provider, providerproductid ORDER BY createdat, id))"""
_PAIRS = (("title", "t0"), ("pricetext", "x0"), ("price", "p0"), ("url", "u0"), ("source", "s0"))


def _satellite(kind: str, test: str) -> str:
    some = " OR ".join(f"r_{a} {test}" for a, _ in _PAIRS)
    differs = " OR ".join(f"(r_{a} {test} AND {a} IS DISTINCT FROM {b})" for a, b in _PAIRS)
    return f"SELECT provider, providerproductid, '{kind}' AS satellite, epoch_us(createdat) AS validfrom_us FROM n CROSS JOIN rate WHERE ({some}) AND (rn = 1 OR {differs})"


SQL: dict[str, str] = {
    "p1_satellites": f"""{_STEPS},
    rate AS (SELECT {", ".join(f"coalesce(avg(({a} IS DISTINCT FROM {b})::INT), 0) AS r_{a}" for a, b in _PAIRS)} FROM n WHERE rn > 1)
    {_satellite("fast", ">= 0.1")} UNION ALL {_satellite("slow", "< 0.1")}""",
    "p1_appended": f"SELECT provider, providerproductid, epoch_us(createdat) AS validfrom_us FROM ({_VERSIONS}) v",
    "p1_found": f"SELECT provider, providerproductid, epoch_us(createdat) AS validfrom_us FROM ({_VERSIONS}) v",
    "p1_periods": f"""
    SELECT provider, providerproductid, price, epoch_us(createdat) AS validfrom_us,
           lead(epoch_us(createdat)) OVER (PARTITION BY provider, providerproductid ORDER BY createdat, id) AS validto_us
    FROM ({_VERSIONS}) v""",
    "p4_found": _AMOUNTS,
    "p4_flagged": _FLAGGED,
    "p4_ambiguous": f"SELECT a.tablename, a.field, f.id IS NULL AS \"unique\", count(*) AS n FROM ({_AMOUNTS}) a LEFT JOIN ({_FLAGGED}) f ON a.tablename = f.tablename AND a.id = f.id AND a.field = f.field GROUP BY ALL",
    "p1_change_rates": """
    WITH one AS (SELECT DISTINCT id, provider, providerproductid, title, pricetext, price, url, source, createdat FROM raw_products WHERE providerproductid IS NOT NULL),
    n AS (SELECT *, lag(title) OVER w AS t0, lag(pricetext) OVER w AS x0, lag(price) OVER w AS p0, lag(url) OVER w AS u0, lag(source) OVER w AS s0,
                 row_number() OVER w AS rn
          FROM one WINDOW w AS (PARTITION BY provider, providerproductid ORDER BY createdat, id)),
    s AS (SELECT * FROM n WHERE rn > 1)
    SELECT a AS attribute, count(*) AS steps, sum(c) / count(*)::DOUBLE AS rate FROM (
      SELECT 'title' AS a, (title IS DISTINCT FROM t0)::INT AS c FROM s UNION ALL SELECT 'pricetext', (pricetext IS DISTINCT FROM x0)::INT FROM s
      UNION ALL SELECT 'price', (price IS DISTINCT FROM p0)::INT FROM s UNION ALL SELECT 'url', (url IS DISTINCT FROM u0)::INT FROM s
      UNION ALL SELECT 'source', (source IS DISTINCT FROM s0)::INT FROM s) r
    GROUP BY a""",
}
