"""Top N items of every group, exact for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.operators.rangescan import range_scan


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """(group, rank_no, ident, score) of the ``n`` best rows of each group.

    All rows are sorted once over the cluster by group, score (high to low) and identifier, in ranges
    that split a large group over many tasks; the counts of each range's groups are prefix-summed into
    exact positions. Equal scores go by the smaller identifier, equal rows both keep a position. Rows
    with a null group or a null or NaN score do not count; -0.0 equals 0.0; infinities are scores.
    An empty table or n < 1 gives no rows. Other columns of ``df`` are not read.
    """
    light = df.select(F.col(group).alias("g"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"), F.col(ident).alias("i"))
    light = light.filter("g is not null and s is not null and not isnan(s)")
    ranked = range_scan(light, ["g"], [F.col("s").desc(), F.col("i").asc_nulls_last()], {"rank_no": ("row_number", None)}, keep=F.col("rank_no") <= n)
    return ranked.select(F.col("g").alias(group), F.col("rank_no").cast("int").alias("rank_no"), F.col("i").alias(ident), F.col("s").alias(score))
