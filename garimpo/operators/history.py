"""History of changing attributes: insert-only satellites with hash-diffs, and period views on them.

A satellite holds one row per version of a key's attributes: key columns, attributes, `hash_diff`, `valid_from`.
Rows are only ever appended; where a version ends is not stored but read from the next version (`periods`).

No key is ever held in one task: neighbours are looked up within (key, time bucket), and only the first and the
last row of a bucket meet in a second, key-wide step, so a key with a third of all rows costs two rows a bucket there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

#: Name prefix of helper columns; input columns of the same name would be overwritten, so it is unlikely on purpose.
_H = "__hist_"


def hash_diff(attributes: Sequence[str]) -> Column:
    """64-bit hash of the attributes; null and absent attributes keep their place, so (a, null) differs from (null, a)."""
    return F.xxhash64(*[x for a in attributes for x in (F.col(a), F.col(a).isNull())])


def neighbours(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str, out: str, *, following: bool = False, bucket_us: int = 7 * DAY_US
) -> DataFrame:
    """df with `out`: `value` of the key's row before (or, with `following`, after) each row by (ts, tie); null at the end.

    Rows whose neighbour lies in the same bucket are settled there. Only the bucket's outer rows are compared across
    buckets, in a window that holds at most two rows a bucket and key. Null timestamps count as the earliest bucket.
    """
    first, last, bucket, inner = (_H + x for x in ("first", "last", "bucket", "inner"))
    df = df.withColumn(bucket, F.coalesce(F.floor(F.unix_micros(F.col(ts)) / F.lit(bucket_us)), F.lit(-(1 << 40))))
    order = [F.col(c).desc() if following else F.col(c).asc() for c in (ts, *tie)]
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))  # a boxed null is a value, an absent box is the bucket's end
    df = df.withColumn(inner, F.lag(boxed).over(w)).withColumn(last, F.lead(F.lit(True)).over(w).isNull()).withColumn(first, F.col(inner).isNull())
    edge = F.col(first) | F.col(last)
    group = F.when(edge, F.lit(None).cast("long")).otherwise(F.col(bucket))
    w2 = Window.partitionBy(*keys, _H + "group").orderBy(*order)
    df = df.withColumn(_H + "group", group).withColumn(_H + "outer", F.lag(boxed).over(w2))
    df = df.withColumn(out, F.when(F.col(first), F.col(_H + "outer")).otherwise(F.col(inner))["v"])
    return df.drop(*[_H + x for x in ("first", "last", "bucket", "inner", "group", "outer")])


def changes(observations: DataFrame, keys: Sequence[str], attributes: Sequence[str], ts: str, tie: Sequence[str] = (), *, bucket_us: int = 7 * DAY_US) -> DataFrame:
    """The satellite of `attributes` over all `observations`: the rows at which a key's attributes start or differ from before.

    Observations with a null key column or null `ts` state no period and are left out. Repeated deliveries (equal rows)
    change nothing. Equal `ts` of one key are ordered by `tie`; if they differ, each starts a version and the earlier
    ones have no length. A value that returns starts a new version. An empty input gives an empty satellite.

    In-bucket repetitions are dropped before the second exchange, so it carries only changes and bucket edges.
    """
    first, last, bucket, before = (_H + x for x in ("first", "last", "bucket", "before"))
    known = F.lit(True)
    for c in (*keys, ts):
        known = known & F.col(c).isNotNull()
    df = observations.filter(known).select(*dict.fromkeys((*keys, *attributes, ts, *tie))).withColumn("hash_diff", hash_diff(attributes))
    df = df.withColumn(bucket, F.floor(F.unix_micros(F.col(ts)) / F.lit(bucket_us)))
    order = [F.col(c).asc() for c in (ts, *tie)]
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    df = df.withColumn(before, F.lag("hash_diff").over(w)).withColumn(last, F.lead("hash_diff").over(w).isNull()).withColumn(first, F.col(before).isNull())
    df = df.filter(F.col(first) | F.col(last) | (F.col("hash_diff") != F.col(before)))
    w2 = Window.partitionBy(*keys, _H + "group").orderBy(*order)
    df = df.withColumn(_H + "group", F.when(F.col(first) | F.col(last), F.lit(None).cast("long")).otherwise(F.col(bucket)))
    df = df.withColumn(_H + "outer", F.lag("hash_diff").over(w2))
    before_any = F.when(F.col(first), F.col(_H + "outer")).otherwise(F.col(before))
    kept = df.filter(before_any.isNull() | (before_any != F.col("hash_diff")))
    return kept.select(*keys, *[a for a in attributes if a not in keys], "hash_diff", F.col(ts).alias("valid_from"), *[t for t in tie if t not in keys and t not in attributes])


def append(satellite: DataFrame, batch: DataFrame, history: DataFrame, keys: Sequence[str], attributes: Sequence[str], ts: str, tie: Sequence[str] = (), *, bucket_us: int = 7 * DAY_US) -> DataFrame:
    """The rows to append to `satellite` for a `batch` of further observations, some of which may be late.

    `history` holds the observations the satellite was built from. A late row can split a version whose second half the
    satellite never stored, so keys of the batch with a row not newer than all of their history are rebuilt from it; of the
    other keys only the newest time is read there.
    Rows of the satellite that a late row made redundant stay; `periods` reads over them.
    """
    keys = list(keys)
    now = batch.select(*dict.fromkeys((*keys, *attributes, ts, *tie)))
    mine = now.select(*keys).distinct()
    newest = history.select(*keys, ts).join(mine, keys, "left_semi").groupBy(*keys).agg(F.max(ts).alias(_H + "newest"))
    late = now.join(newest, keys).filter(F.col(ts) <= F.col(_H + "newest")).select(*keys).distinct()
    stored = satellite.join(mine, keys, "left_semi")
    known = stored.select(*keys, *attributes, F.col("valid_from").alias(ts), *[t for t in tie if t not in keys])
    known = known.unionByName(history.join(late, keys, "left_semi").select(*known.columns))
    after = changes(known.unionByName(now.select(*known.columns)), keys, attributes, ts, tie, bucket_us=bucket_us)
    return after.join(stored.select(*keys, "valid_from", "hash_diff"), [*keys, "valid_from", "hash_diff"], "left_anti").select(*satellite.columns)


def periods(satellite: DataFrame, keys: Sequence[str], tie: Sequence[str] = (), *, bucket_us: int = 7 * DAY_US) -> DataFrame:
    """The satellite's versions with `valid_to`: the start of the next one, null while a version holds."""
    df = neighbours(satellite, keys, "valid_from", tie, "hash_diff", _H + "was", bucket_us=bucket_us)
    df = df.filter(F.col(_H + "was").isNull() | (F.col(_H + "was") != F.col("hash_diff"))).drop(_H + "was")
    return neighbours(df, keys, "valid_from", tie, "valid_from", "valid_to", following=True, bucket_us=bucket_us)


def as_of(satellite: DataFrame, keys: Sequence[str], moment: Column, tie: Sequence[str] = ()) -> DataFrame:
    """The version of each key that holds at `moment`; keys that start later are absent."""
    rest = [c for c in satellite.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("valid_from", *tie)).alias(_H + "v")
    return satellite.filter(F.col("valid_from") <= moment).groupBy(*keys).agg(newest).select(*keys, _H + "v.*")


def change_rates(observations: DataFrame, keys: Sequence[str], attributes: Sequence[str], ts: str, tie: Sequence[str] = (), *, bucket_us: int = 7 * DAY_US) -> DataFrame:
    """One row per attribute: `steps` (observations that have one before) and `rate`, the share of steps at which it differs."""
    df = observations.select(*dict.fromkeys((*keys, *attributes, ts, *tie))).withColumn(_H + "all", F.array(*[F.xxhash64(F.col(a), F.col(a).isNull()) for a in attributes]))
    df = neighbours(df, keys, ts, tie, _H + "all", _H + "was", bucket_us=bucket_us).filter(F.col(_H + "was").isNotNull())
    changed = [F.sum((F.col(_H + "all")[i] != F.col(_H + "was")[i]).cast("long")).alias(a) for i, a in enumerate(attributes)]
    one = df.agg(F.count("*").alias(_H + "steps"), *changed)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("changed")) for a in attributes]))
    return one.select(F.col(_H + "steps").alias("steps"), rows.alias("r")).select("r.attribute", "steps", F.try_divide(F.col("r.changed"), F.col("steps")).alias("rate"))


def split_by_rate(rates: dict[str, float | None], fast_from: float = 0.1) -> tuple[list[str], list[str]]:
    """Attributes for a fast and a slow satellite, given `change_rates` as a mapping (one entry per attribute)."""
    fast = [a for a, r in rates.items() if r is not None and r >= fast_from]
    return fast, [a for a in rates if a not in fast]
