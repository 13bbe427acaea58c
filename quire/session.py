"""Session helpers: sessions for tests and benches, lineage cuts, shared work folders."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int = 8, app: str = "quire", memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the
    session, or, where it is unset in a local session (tests), a temporary folder
    of ours.  On a cluster there is no folder to guess: it must be set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by an eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage
    cut whose reader still prunes columns and pushes filters."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> DataFrame:
    """``df``, a landed table, after the exchanges that made it are gone from the executors' disks: Spark drops them when the driver collects its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def scattered(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` by the columns over as many partitions as the session's shuffles have:
    for work that is heavy for its bytes, which must not be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
