"""A feed of snapshots kept up to date by Structured Streaming: each micro-batch merges into a table of latest builds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalith.operators.orphans import merge_counts
from catalith.operators.payloads import listed_names


def latest(builds: DataFrame) -> DataFrame:
    """Of each source the row with the latest built_at, then the largest snap_id."""
    cols = [c for c in builds.columns if c != "source"]
    return builds.groupBy("source").agg(F.max(F.struct("built_at", "snap_id", *[c for c in cols if c not in ("built_at", "snap_id")])).alias("m")).select("source", "m.*")


def merge_into(spark: SparkSession, batch: DataFrame, folder: str, batch_id: int) -> None:
    """Writes the merge of a batch and the state before it as a new version; the pointer is moved last, so that a batch that is run again changes nothing.

    Beside the latest builds a version holds the signed counts of each table name (``counts``), moved on by the deltas of
    the sources that the batch changes: their new builds' references and listings are added, those of the builds that they replace taken back."""
    old = current(spark, folder, batch_id)
    both = batch if old is None else batch.select(*old.columns).unionByName(old)
    latest(both).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")
    new = spark.read.parquet(f"{folder}/v={batch_id}")
    deltas = _counts(new, 1) if old is None else _counts(new.join(old, _same(new, old), "left_anti"), 1).unionByName(_counts(old.join(new, _same(old, new), "left_anti"), -1))
    before = counts(spark, folder, batch_id)
    merge_counts(deltas if before is None else before.unionByName(deltas)).write.mode("overwrite").parquet(f"{folder}/counts/v={batch_id}")
    spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def _same(a: DataFrame, b: DataFrame):
    return a["source"].eqNullSafe(b["source"]) & a["built_at"].eqNullSafe(b["built_at"]) & a["snap_id"].eqNullSafe(b["snap_id"])


def _counts(builds: DataFrame, sign: int) -> DataFrame:
    """key, refs, exist of these builds, times ``sign``."""
    named = listed_names(builds.select("source", "payload"), ["source"]).distinct()
    one = named.select("source", F.col("table_key").alias("key"), F.when(F.col("side") == "table", F.lit(-1)).otherwise(F.col("pos")).alias("pos"), "side").distinct()
    refs, exist = F.count_if(F.col("side") != "table"), F.count_if(F.col("side") == "table")
    return one.groupBy("key").agg((sign * refs).alias("refs"), (sign * exist).alias("exist"))


def _version(spark: SparkSession, folder: str, before: int | None) -> int | None:
    """The last finished version (of a batch before ``before``), or None where none is written yet. Any other trouble with reading is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    v = spark.read.schema("version long").parquet(f"{folder}/versions")
    return (v if before is None else v.filter(F.col("version") < before)).agg(F.max("version")).first()[0]


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The latest builds as the last finished batch left them, or None."""
    v = _version(spark, folder, before)
    return None if v is None else spark.read.parquet(f"{folder}/v={v}")


def counts(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """key, refs, exist of the latest builds, as the last finished batch left them, or None; ``orphans_now`` of them is the orphan report."""
    v = _version(spark, folder, before)
    return None if v is None else spark.read.parquet(f"{folder}/counts/v={v}")


def follow(spark: SparkSession, feed: DataFrame, folder: str) -> StreamingQuery:
    """Starts merging a stream of snapshots rows (the columns of the snapshots table) until it has seen all that is there."""
    return feed.writeStream.foreachBatch(lambda df, i: merge_into(df.sparkSession, df, folder, i)).option("checkpointLocation", os.path.join(folder, "_progress")).trigger(availableNow=True).start()


def late_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream by window and key; rows later than ``late`` behind the newest are left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
