"""Distributed positions in a hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 3  # 4,096 buckets of the digest's leading hex digits


def hash_positions(df: DataFrame, by: list[str], digest: str, tie: str, position: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in the order of (digest, tie) within ``by``, and the group's size ``n``.

    ``digest`` is a hex digest.  Groups of any size are ranked in buckets of its
    leading digits; the offsets are sums of at most 4,096 counts a group.
    """
    bucketed = df.withColumn("_bucket", F.substring(digest, 1, _DIGITS))
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_count"))
    group = Window.partitionBy(*by)
    offsets = counts.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_count").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_count").over(group).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(digest, tie))
    ranked = bucketed.withColumn("_inside", inside)
    return ranked.join(offsets, [*by, "_bucket"]).withColumn(position, F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_inside", "_before")
