"""Mixing sources to target weights of tokens, with a cap on how often a document is repeated.

Every document gets a hash-random key. Within its source the documents are laid out in the order of their keys; prefix sums
of their tokens say where each one ends, and each source is cut exactly at its budget. Whole epochs come first: a budget of
2.3 times a source's tokens takes every document twice and those of the first 0.3 in the order of the keys once more.

Prefix sums are distributed: keys are cut into equal ranges, the ranges' sums are accumulated per source (a few thousand
rows), and running sums are taken within a range only. So a source with most of the rows is spread over all ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: File of a public tokenizer; the default of the parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents that one range of keys holds on average, at most.
RANGE_ROWS = 100_000


def token_counts(documents: DataFrame, text: str = "text", path: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """documents with `text` replaced by its number of tokens (null and empty texts have 0).

    `path`: a `tokenizers` file. Where the driver has it, it is shipped to the executors with the job.
    """
    if Path(path).exists():
        documents.sparkSession.sparkContext.addFile(path)
    rest = [c for c in documents.columns if c != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        shipped = SparkFiles.get(Path(path).name)
        if not Path(shipped).exists() and not Path(path).exists():
            raise FileNotFoundError(f"tokenizer file {path} is missing on this executor")
        tokenizer = Tokenizer.from_file(shipped if Path(shipped).exists() else path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            counted = [len(e.ids) for k in range(0, len(batch), 256) for e in tokenizer.encode_batch_fast(batch[text].fillna("").iloc[k : k + 256].tolist(), add_special_tokens=False)]
            yield batch[rest].assign(**{out: pd.Series(counted, index=batch.index, dtype="int64")})

    fields = [f"`{n}` {t}" for n, t in documents.select(*rest).dtypes]
    return documents.mapInPandas(count, ", ".join([*fields, f"`{out}` bigint"]))


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, targetshare, maxrepeats, available, documents, budget) for each target source.

    `total`: tokens of the mixture; by default the largest total at which every source that exists can meet its share within
    its repeats. A source without tokens gets a budget of 0 and a budget is never more than available * maxrepeats.
    A null or non-positive share or cap counts as 0.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    share = F.greatest(F.coalesce(F.col("targetshare"), F.lit(0.0)), F.lit(0.0))
    cap = F.greatest(F.coalesce(F.col("maxrepeats"), F.lit(0)), F.lit(0))
    t = targets.select("source", share.alias("targetshare"), cap.alias("maxrepeats")).join(have, "source", "left").fillna(0, ["available", "documents"])
    reach = F.col("available") * F.col("maxrepeats")
    largest = F.min(F.when((F.col("targetshare") > 0) & (reach > 0), F.floor(reach / F.col("targetshare")))).over(Window.partitionBy())
    wanted = F.lit(total).cast("double") if total is not None else F.coalesce(largest, F.lit(0)).cast("double")
    return t.withColumn("budget", F.least(F.floor(wanted * F.col("targetshare") + F.lit(1e-6)), reach).cast("long"))


def draw(sized: DataFrame, budget: DataFrame, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the drawn documents; `sized` is (doc_id, source, tokens), `budget` from `budgets`.

    Documents without a target source, with a null source or without tokens aren't drawn. A document that would pass the
    budget of its last epoch isn't drawn in it, so a source stays below its budget by less than one document.
    """
    rows = sized.count()
    ranges = max(1, -(-rows // range_rows))
    b = budget.select("source", "available", "budget", F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0).alias("epochs"))
    b = b.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    key = F.xxhash64(F.lit(seed), "doc_id")
    part = F.least(F.floor((key.cast("double") + 2.0**63) / 2.0**64 * ranges), F.lit(ranges - 1)).cast("int")
    # The targets are a small list of names, one row each: they are known to fit a broadcast by their count.
    small = F.broadcast(b) if budget.count() <= 100_000 else b
    keyed = sized.filter(F.col("tokens") > 0).join(small, "source").withColumn("key", key).withColumn("range", part)
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")
    offsets = sums.select("source", "range", before.alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("inside", inside).join(offsets, ["source", "range"]).withColumn("ends", F.col("before") + F.col("inside"))
    repeats = F.col("epochs") + (F.col("ends") <= F.col("rest")).cast("int")
    return placed.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).filter(F.col("repeats") > 0)


def shares(drawn: DataFrame, budget: DataFrame) -> DataFrame:
    """One row per target source: what was wanted, what was available and what was reached."""
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("drawn"), F.max("repeats").alias("mostrepeats"))
    all_ = F.sum("tokens").over(Window.partitionBy())
    df = budget.select("source", "targetshare", "maxrepeats", "available", "budget").join(got, "source", "left").fillna(0, ["tokens", "drawn", "mostrepeats"])
    return df.withColumn("share", F.try_divide(F.col("tokens"), all_))
