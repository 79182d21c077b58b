"""Session factory and the shared scratch area for written intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "threadloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for local work; on a cluster, pass the session you were given instead."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only where that is unset in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), f"threadloom-{os.getuid()}")
    os.makedirs(local, exist_ok=True)
    return f"file://{local}"


class Scratch:
    """Cuts lineage by writing tables in the shared folder.

    Written tables survive the loss of any executor. ``drop`` removes one that no later
    plan reads; what the returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)  # gone when the application ends
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(where)

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
