"""Session helpers: settings, table loading and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Settings that an own session gets; a given session is left as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", partitions: int = 8, driver_memory: str = "8g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("catalith")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": driver_memory, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share for cut lineages.

    The cluster names it in spark.checkpoint.dir. Only where that is unset, as in
    tests on one machine, a temporary folder is made.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="catalith-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: they survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """The same rows as a written table in the shared folder. Unlike ``cut`` the order and partitions of rows are not kept, but the table's size
    is known (Spark broadcasts it in joins if it is small), and readers read only the columns and rows that they need."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_all(*dfs: DataFrame) -> list[DataFrame]:
    """``store`` of each, at the same time: for tables that don't need each other."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(store, dfs))
