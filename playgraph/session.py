"""Session factory and the lineage-cutting helper."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "playgraph", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator relies on (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests)
    a temporary folder is made and remembered for the session."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.playgraph.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        at = "file://" + tempfile.mkdtemp(prefix="playgraph-")
        spark.conf.set("spark.playgraph.shared.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage (reliable checkpoint, survives executor loss)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(os.path.join(shared_dir(spark), "checkpoints"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then does Spark remove the shuffle files and checkpoints of frames that nothing refers
    to, and a driver that has built many plans gives its memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
