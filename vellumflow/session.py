"""Session construction and cluster-wide settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup side that may be broadcast after they have been counted.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vellumflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a local one in local
    mode and an error on a cluster, whose executors could not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vellum-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/vellum-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to ``path`` or the shared folder and read again: like ``cut``, but in compressed
    columns, for what is large. A local folder is removed at the end; on a cluster it is left."""
    path = path or shared_path(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``max_rows`` rows, else ``df``
    as it is, so that the join shuffles. The count stops at the bound."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def only(df: DataFrame, few: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` whose key stands in ``few``, without a shuffle of ``df`` where the keys
    may be broadcast. ``few`` is counted, so it should be written or cheap."""
    return df.join(broadcast_checked(few.select(key).distinct(), max_rows), key, "left_semi")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, at: str = "loaded_at", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per ``key``: the one with the last ``at``.

    Only keys delivered more than once need work, so the wide rows are not shuffled: the
    repeated keys come from a scan of two columns, are written once, and are joined back
    (broadcast if few) in one pass over the rows. Only for keys whose last ``at`` itself is
    repeated are rows compared, by ``dropDuplicates``. A NULL key is kept as it is.
    """
    times = df.filter(F.col(key).isNotNull()).groupBy(key, at).agg(F.count(F.lit(1)).alias("n"))
    last = times.groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("n"), F.max(F.struct(F.col(at).alias("at"), "n")).alias("last"))
    again = cut(last.filter("n > 1").select("_key", F.col("last.at").alias("_at"), (F.col("last.n") > 1).alias("_tied")))
    joined = df.join(broadcast_checked(again, max_rows), F.col(key) == F.col("_key"), "left")
    kept = joined.filter(F.col("_key").isNull() | F.col(at).eqNullSafe(F.col("_at")))
    if again.filter("_tied").isEmpty():
        return kept.select(*df.columns)
    tied = F.coalesce("_tied", F.lit(False))
    return kept.filter(~tied).select(*df.columns).unionByName(kept.filter(tied).select(*df.columns).dropDuplicates([key]))
