"""Pairs of canonical devices: all of them against a catalogue or each other, or only those that can match."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.operators.compare import CAPACITY_TOLERANCE, INPUTS, WARRANTY, capacity_ratio, compare, normal_brand

#: Rows of a side that may be broadcast for an all-pairs comparison.
BROADCAST_ROWS = 10_000


def _facts(df: DataFrame) -> Column:
    return F.struct(*INPUTS, *([WARRANTY] if WARRANTY in df.columns else []))


def _side(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    return df.select(_facts(df).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in keep])


def without_facts(normalized: DataFrame) -> DataFrame:
    """Normalized rows as devices with brand and model only, for a comparison of normalized rather than canonical rows.

    Fields that are absent on both sides count for a match, so rows of one brand with different models still match.
    """
    none = {c: F.lit(None).cast("int" if c in ("capacityGB", "pcieGeneration") else "string") for c in INPUTS if c not in ("brand", "model")}
    return normalized.withColumns(none)


def is_small(df: DataFrame) -> bool:
    """Whether df may be broadcast by its rows, which are counted up to BROADCAST_ROWS: the size of files says little of them."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def against(devices: DataFrame, catalogue: DataFrame, keep: list[str]) -> DataFrame:
    """Every device with every row of `catalogue`, judged. `keep` names columns of both to carry, as l_... and r_....

    The catalogue is broadcast if it has at most BROADCAST_ROWS rows (it is counted first); else Spark plans the product.
    """
    right = _side(catalogue, "r", keep)
    return compare(_side(devices, "l", keep).crossJoin(F.broadcast(right) if is_small(right) else right))


def each_with_each(devices: DataFrame, order: str, keep: list[str]) -> DataFrame:
    """Every pair (l before r by `order`) once, judged: n(n-1)/2 rows, so for distinct tuples or small sets."""
    keep = list(dict.fromkeys([order, *keep]))
    return compare(_side(devices, "l", keep).join(_side(devices, "r", keep), F.col(f"l_{order}") < F.col(f"r_{order}")))


def distinct_devices(devices: DataFrame, id_column: str) -> DataFrame:
    """One row per different device: INPUTS, `first` (least id) and `n` (rows it stands for). Comparing these suffices."""
    return devices.groupBy(*INPUTS).agg(F.min(id_column).alias("first"), F.count("*").alias("n"))


def _bucket(gb: Column) -> Column:
    """Log-scale bucket of a capacity; capacities within the tolerance are at most one bucket apart."""
    return F.floor(F.ln(gb.cast("double")) / F.lit(-math.log(1 - CAPACITY_TOLERANCE))).cast("long")


def matching(devices: DataFrame, order: str, keep: list[str]) -> DataFrame:
    """The pairs of `each_with_each` with verdict IDENTICAL or LIKELY_IDENTICAL, without comparing all of them.

    A brand mismatch caps the confidence below any match, and so does a capacity mismatch. So a match has the same normal
    brand (or none on both sides) and capacities within the tolerance (or none): an equality join on brand and capacity
    bucket, one side spread to the neighbouring buckets, finds every match; the exact rules then decide.
    """
    keep = list(dict.fromkeys([order, *keep]))
    usable = devices.filter(F.col("capacityGB").isNull() | (F.col("capacityGB") > 0))
    keyed = usable.withColumns({"__brand": F.coalesce(normal_brand(F.col("brand")), F.lit("")), "__bucket": F.coalesce(_bucket(F.col("capacityGB")), F.lit(-(1 << 40)))})
    left = keyed.select(_facts(keyed).alias("l"), *[F.col(c).alias(f"l_{c}") for c in keep], "__brand", "__bucket")
    spread = F.explode(F.array(*[F.col("__bucket") + d for d in (-2, -1, 0, 1, 2)])).alias("__bucket")
    right = keyed.select(_facts(keyed).alias("r"), *[F.col(c).alias(f"r_{c}") for c in keep], F.col("__brand"), spread)
    near = F.col("l.capacityGB").isNull() | (capacity_ratio(F.col("l.capacityGB"), F.col("r.capacityGB")) <= CAPACITY_TOLERANCE)
    pairs = left.join(right, ["__brand", "__bucket"]).filter((F.col(f"l_{order}") < F.col(f"r_{order}")) & near).drop("__brand", "__bucket")
    return compare(pairs).filter(F.col("verdict").isin("IDENTICAL", "LIKELY_IDENTICAL"))


def offer_pairs(devices: DataFrame, order: str) -> DataFrame:
    """Greedy offers: (first, second, verdict, confidence), each device in at most one row; `second` is null for leftovers.

    Matches are taken in the order of (first, second) while neither side is taken. Matches never cross a normal brand, nor
    a gap between capacities wider than the tolerance, so each brand and range of capacities is settled on its own; what
    is settled there are matches of distinct devices, not rows.
    """
    import pandas as pd

    m = matching(devices, order, ["brand", "capacityGB"])
    m = m.select(normal_brand(F.col("l_brand")).alias("brand"), F.col("l_capacityGB").alias("gb"), F.col(f"l_{order}").alias("first"), F.col(f"r_{order}").alias("second"), "verdict", "confidence")
    # Different capacities are few; a range starts where the one before is out of tolerance.
    sizes = devices.filter(F.col("capacityGB") > 0).select(normal_brand(F.col("brand")).alias("b"), F.col("capacityGB").alias("g")).distinct()
    by_size = Window.partitionBy("b").orderBy("g")
    apart = F.coalesce(capacity_ratio(F.col("g"), F.lag("g").over(by_size)) > CAPACITY_TOLERANCE, F.lit(True))
    ranges = sizes.withColumn("start", apart.cast("int")).withColumn("range", F.sum("start").over(by_size.rowsBetween(Window.unboundedPreceding, 0))).select("b", "g", "range")
    m = m.join(ranges, F.col("brand").eqNullSafe(F.col("b")) & (F.col("gb") == F.col("g")), "left").select("brand", F.coalesce("range", F.lit(-1)).alias("range"), "first", "second", "verdict", "confidence")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        rows = []
        for row in pdf.sort_values(["first", "second"]).itertuples(index=False):
            if row.first not in taken and row.second not in taken:
                taken |= {row.first, row.second}
                rows.append((row.first, row.second, row.verdict, row.confidence))
        return pd.DataFrame(rows, columns=["first", "second", "verdict", "confidence"])

    kind = dict(devices.dtypes)[order]
    taken = m.groupBy("brand", "range").applyInPandas(greedy, f"first {kind}, second {kind}, verdict string, confidence double")
    used = taken.select(F.explode(F.array("first", "second")).alias(order))
    alone = devices.join(used, order, "left_anti").select(F.col(order).alias("first"), F.lit(None).cast(kind).alias("second"), F.lit("UNKNOWN").alias("verdict"), F.lit(0.5).alias("confidence"))
    return taken.unionByName(alone)
