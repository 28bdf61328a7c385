"""Places and batches within groups of any size: no group is sorted in one task, no batch is cut where a partition ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint


def numbered(rows: DataFrame, by: str, order: list[str | Column], place: str = "nth") -> DataFrame:
    """Adds each row's place (from 0) in its group, by an order; rows that agree in it have any order among themselves.

    Rows are dealt by ranges of group and order. Each part numbers its own, and the sizes of the parts before it, one small row
    for each part and group, are added. Null is a group as well.
    """
    named = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = rows.withColumns({f"order{k}_": o for k, o in enumerate(named)})
    keys = [by, *(f"order{k}_" for k in range(len(named)))]
    parts = checkpoint(dealt.repartitionByRange(*keys).withColumn("part_", F.spark_partition_id()))
    sizes = parts.groupBy("part_", by).agg(F.count("*").alias("size_"))
    before = Window.partitionBy(by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("part_").alias("of_"), F.col(by).alias("by_"), F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("first_"))
    within = F.row_number().over(Window.partitionBy("part_", by).orderBy(*keys[1:])) - 1
    found = parts.withColumn("within_", within).join(first, (F.col("part_") == F.col("of_")) & F.col(by).eqNullSafe(F.col("by_")))
    return found.withColumn(place, F.col("first_") + F.col("within_")).drop("part_", "of_", "by_", "first_", "within_", *keys[1:])


def batches(rows: DataFrame, by: str, order: list[str | Column], size: int) -> DataFrame:
    """One row for each batch of a group: by, batch, and rows (array of struct, in order); all of that size but a group's last."""
    columns = rows.columns
    placed = numbered(rows, by, order).withColumn("batch", F.floor(F.col("nth") / size))
    listed = placed.groupBy(by, "batch").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct(*columns).alias("row")))).alias("rows"))
    return listed.select(by, "batch", F.transform("rows", lambda r: r["row"]).alias("rows"))
