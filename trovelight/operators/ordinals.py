"""Positions within groups that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_within(
    rows: DataFrame, group: str, bucket: Column, order: tuple[str, ...], name: str = "ordinal"
) -> DataFrame:
    """Dense 0-based position per group, and the group's size as ``n_<name>``.

    `bucket` must grow with `order`. Rows are numbered inside (group, bucket), and
    a running total over the far fewer buckets shifts them, so no task ever sorts
    a whole hot group.
    """
    tagged = rows.withColumn("_bucket", bucket)
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        tagged.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn(f"n_{name}", F.sum("_size").over(Window.partitionBy(group)))
        .drop("_size")
    )
    return (
        tagged.withColumn("_local", F.row_number().over(inside) - 1)
        .join(sizes, [group, "_bucket"])
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .drop("_local", "_shift", "_bucket")
    )


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """`rows` with ``is_first``: whether the row is its key's first by `order` (unique).

    The winner per key comes from a partial aggregate and is matched back on the
    unique `order` value, so a key shared by a third of the rows is never a hot
    join or window partition.
    """
    winners = rows.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return rows.join(winners.withColumn("_won", F.lit(True)), order, "left").withColumn(
        "is_first", F.coalesce("_won", F.lit(False))
    ).drop("_won")
