"""A deterministic view of shop listings over the `part` table: three shops, one listing each per part.

The SQL runs unchanged on any engine with ANSI functions; it takes the name of the `part` relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from garimpo.sources.tables import table

LISTINGS_SQL = """
SELECT listing_id, provider, k, concat_ws(' ', noise, 'SSD', brand, model, capacity, interface, pcie) AS title,
       concat('R$ ', CASE WHEN reais >= 1000 THEN concat(CAST(CAST(floor(reais / 1000.0) AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(reais % 1000 AS VARCHAR(20)), 3, '0'))
                          ELSE CAST(reais AS VARCHAR(20)) END, ',', lpad(CAST(cents % 100 AS VARCHAR(20)), 2, '0')) AS price_text,
       CASE WHEN k % 13 = 0 AND j = 1 THEN NULL WHEN k % 11 = 0 AND j = 2 THEN concat('https://pichau.example/p/', CAST(k AS VARCHAR(20)))
            ELSE concat('https://', provider, '.example/p/', CAST(k AS VARCHAR(20))) END AS url
FROM (
  SELECT k, j, 3 * k + j AS listing_id, cents, CAST(floor(cents / 100.0) AS BIGINT) AS reais,
         CASE j WHEN 0 THEN 'pichau' WHEN 1 THEN 'kabum' ELSE 'mercadolivre' END AS provider,
         CASE WHEN j = 1 AND k % 5 = 0 THEN 'Produto Patrocinado' END AS noise,
         CASE k % 8 WHEN 0 THEN 'Samsung' WHEN 1 THEN 'Kingston' WHEN 2 THEN CASE WHEN j = 1 THEN 'Western Digital' ELSE 'WD' END
                    WHEN 3 THEN 'Crucial' WHEN 4 THEN 'Corsair' WHEN 5 THEN 'Lexar' WHEN 6 THEN 'XPG' END AS brand,
         CASE k % 8 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN '990 PRO' ELSE '870 EVO' END WHEN 1 THEN 'A400' WHEN 2 THEN 'Blue SN580'
                    WHEN 3 THEN 'MX500' WHEN 4 THEN 'MP600' WHEN 5 THEN 'NM790' WHEN 6 THEN 'SX8200 Pro' END AS model,
         CASE CAST(floor(k / 8.0) AS BIGINT) % 5 WHEN 0 THEN '480GB' WHEN 1 THEN '500GB' WHEN 2 THEN '1TB' WHEN 3 THEN '2TB' ELSE '960G' END AS capacity,
         CASE WHEN j = 2 AND k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN 'NVMe M.2' ELSE 'SATA' END AS interface,
         CASE WHEN j = 0 AND k % 6 = 0 THEN 'PCIe Gen4' END AS pcie
  FROM (SELECT p_partkey AS k, j, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) + 1990 * j AS cents
        FROM {part} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) shops) x) y"""


def listings(spark: SparkSession, directory: str) -> DataFrame:
    """listing_id (order of arrival), provider, k (part key), title, price_text, url (null for some)."""
    return spark.sql(LISTINGS_SQL, part=table(spark, directory, "part", "p_partkey", "p_retailprice"))
