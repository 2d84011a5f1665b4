"""Mapping freely typed values to a canonical list: partition-based pigeonhole join, in SQL only.

A reference form of length n may be typed with up to k(n) edits. It is cut into k+1 segments; k edits leave at least one
segment untouched, moved by at most k places. So every typed value within k edits shares a segment with its reference at
one of the positions start-k .. start+k: an equality join on (kind, position, segment) finds all of them, and the
built-in levenshtein verifies. What finds nothing is reported by an anti-join.

The join runs over the distinct typed values, not the rows: a value typed a billion times is compared once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import is_blank
from garimpo.operators.skew import hot_keys, lookup

# Letters that stand for others (accents, look-alikes of other scripts, digits and signs used as letters).
ACCENTED = ("áàâãäåéèêëíìîïóòôõöúùûüçñý", "aaaaaaeeeeiiiiooooouuuucny")
LOOKALIKE = ("аеорсухіѕјкмнтвԁ", "aeopcyxisjkmhtbd")
LEET = ("@0341$5", "aoealss")
# What sellers write around a name.
BEFORE = r"^(linha|marca|fabricante|fab|by|brand)\b[ .:]*"
AFTER = r"( -)?[ (-]+(loja oficial|oficial|tech br|tech|do brasil|brasil|inc|ltda|oem|bulk|br|original|sa)[).]*$"

#: Reference names that may be broadcast to drop exact values; more are looked up key by key.
BROADCAST_NAMES = 10_000

#: Edits allowed for a reference form of a given length: (least length, edits), longest first.
EDITS = ((10, 4), (8, 3), (6, 2), (4, 1), (0, 0))


def edits_sql(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} >= {n} THEN {k}" for n, k in EDITS) + " END"


def bare_sql(value: str) -> str:
    """SQL for a value without case, accents, look-alikes, invisible characters and what sellers write around a name."""
    x = f"lower({value})"
    x = f"regexp_replace({x}, '[\u00ad\u2000-\u200f\u2060\ufeff\u2122\u00ae\u00a9\u0300-\u036f]', '')"
    for old, new in (ACCENTED, LOOKALIKE, LEET):
        x = f"translate({x}, '{old}', '{new}')"
    x = f"trim(regexp_replace({x}, '[^a-z0-9&().:-]+', ' '))"
    x = f"regexp_replace({x}, '^[^a-z0-9]+', '')"
    before, after = BEFORE.replace("\\", "\\\\"), AFTER.replace("\\", "\\\\")
    x = f"regexp_replace({x}, '{before}', '')"
    for _ in range(2):
        x = f"regexp_replace({x}, '{after}', '')"
    return f"trim(regexp_replace({x}, '[^a-z0-9&]+', ' '))"


_FORMS = """
    SELECT value, explode(array(named_struct('kind', 0, 'form', replace(bare, ' ', '')),
                                named_struct('kind', 1, 'form', array_join(array_sort(split(bare, ' ')), '')))) AS f
    FROM {bare}"""

_JOIN = """
    WITH listed AS (SELECT value AS id, f.kind, f.form, {edits} AS k FROM (SELECT * FROM {listed})),
    typed AS (SELECT value, f.kind, f.form FROM (SELECT * FROM {typed}) WHERE f.form <> '' AND length(f.form) <= (SELECT max(length(form) + k) FROM listed)),
    segment AS (
      SELECT id, kind, form, k, i, 1 + floor(i * length(form) / (k + 1)) AS start,
             substring(form, 1 + floor(i * length(form) / (k + 1)), floor((i + 1) * length(form) / (k + 1)) - floor(i * length(form) / (k + 1))) AS seg
      FROM listed LATERAL VIEW explode(sequence(0, k)) AS i),
    placed AS (SELECT id, kind, form, k, seg, pos FROM segment LATERAL VIEW explode(sequence(greatest(1, start - k), start + k)) AS pos),
    sized AS (SELECT value, kind, form, (SELECT array_sort(collect_set(length(seg))) FROM segment) AS ls FROM typed),
    probe AS (
      SELECT value, kind, form, pos, substring(form, pos, l) AS seg
      FROM sized LATERAL VIEW explode(sequence(1, length(form))) AS pos LATERAL VIEW explode(ls) AS l
      WHERE pos + l - 1 <= length(form)),
    candidate AS (
      SELECT DISTINCT p.value, p.kind, p.form, r.id, r.form AS target, r.k
      FROM probe p JOIN placed r ON p.kind = r.kind AND p.pos = r.pos AND p.seg = r.seg AND abs(length(p.form) - length(r.form)) <= r.k),
    verified AS (
      SELECT value, id, levenshtein(form, target) AS distance FROM candidate WHERE levenshtein(form, target) <= k),
    best AS (SELECT value, id, min(distance) AS distance FROM verified GROUP BY value, id),
    ranked AS (SELECT *, min(distance) OVER (PARTITION BY value) AS least FROM best)
    SELECT value, min(id) AS id, min(distance) AS distance FROM ranked WHERE distance = least GROUP BY value HAVING count(*) = 1"""



def map_values(values: DataFrame, reference: DataFrame, none: int = -1) -> DataFrame:
    """(value, id, distance) for each of the distinct typed `values` (column `value`).

    `reference` is (id, name, short): names may be typed with edits (see EDITS) and in any order of their words, a short
    name (may be null) only exactly. A value nearest to several ids at the same distance, one without letters or digits, or
    one that is near none gets `none` and a null distance. Nulls in `value` are ignored; an empty reference matches nothing.
    """
    spark = values.sparkSession
    distinct = values.filter(F.col("value").isNotNull()).select("value").distinct()
    bare = spark.sql(f"SELECT value, {bare_sql('value')} AS bare FROM {{v}}", v=distinct)
    names = spark.sql(f"SELECT id AS value, {bare_sql('name')} AS bare FROM {{r}} WHERE name IS NOT NULL", r=reference)
    short = spark.sql(f"SELECT {bare_sql('short')} AS bare, min(id) AS id FROM {{r}} WHERE short IS NOT NULL GROUP BY 1 HAVING count(*) = 1", r=reference)
    by_short = spark.sql("SELECT b.value, s.id, 0 AS distance FROM {b} b JOIN {s} s ON replace(b.bare, ' ', '') = replace(s.bare, ' ', '') WHERE b.bare <> ''", b=bare, s=short)
    typed, listed = spark.sql(_FORMS, bare=bare), spark.sql(_FORMS, bare=names)
    near = spark.sql(_JOIN.replace("{edits}", edits_sql("length(f.form)")), typed=typed, listed=listed)
    near = spark.sql("SELECT n.* FROM {n} n LEFT ANTI JOIN {s} s ON n.value = s.value", n=near, s=by_short)
    found = by_short.unionByName(near)
    rest = spark.sql(f"SELECT a.value, CAST({none} AS INT) AS id, CAST(NULL AS INT) AS distance FROM {{a}} a LEFT ANTI JOIN {{f}} f ON a.value = f.value", a=distinct, f=found)
    return found.unionByName(rest)


def map_rows(rows: DataFrame, id_column: str, column: str, reference: DataFrame, out: str, none: int = -1) -> DataFrame:
    """(id_column, out): the mapping of each row whose `column` is neither blank nor exactly a reference name.

    Blank is null, empty or white space only. Values held by many rows (a third of all, say) are spread by `lookup`.
    """
    filled = rows.select(id_column, F.col(column).alias("value")).filter(~is_blank(F.col("value")))
    names = reference.filter(F.col("name").isNotNull()).select(F.col("name").alias("value")).distinct()
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        filled = filled.join(F.broadcast(names), "value", "left_anti")
    else:
        filled = lookup(filled, "value", names.withColumn("__exact", F.lit(True)), "__exact", hot_keys(filled, "value")).filter(F.col("__exact").isNull()).select(id_column, "value")
    mapped = map_values(filled, reference, none).select("value", F.col("id").alias(out))
    hot = hot_keys(filled, "value")
    return lookup(filled, "value", mapped, out, hot).select(id_column, out)
