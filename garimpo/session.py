"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session that this library opens itself; a session that is handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def open_session(name: str = "garimpo", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one if all runs in one process, else an error."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="garimpo-"))
    return sc.getCheckpointDir()


#: Tables and folders of intermediate data that were written in this process.
_cuts: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for intermediate data, not yet there; `drop_cuts` deletes it."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _cuts.append(at)
    return at


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder; nothing happens if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the intermediate data written in this process; call it once their results are stored. Returns how many folders."""
    n = len(_cuts)
    while _cuts:
        delete(spark, _cuts.pop())
    return n


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there.

    Later steps survive the loss of executors and don't replay what led to df. A table rather than checkpoint(): it comes
    with statistics from its files, and without the constraints of the plan, which multiply from round to round in
    iterative operators until the optimiser drowns in them.
    """
    at = new_folder(df.sparkSession, "cut")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
