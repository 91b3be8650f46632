"""Dense numbers in a stated order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.workspace import stored, work_dir

#: The bits of monotonically_increasing_id that count rows within a task.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str = "n", start: int = 0) -> DataFrame:
    """rows with name, a long that counts them from start in the order of the columns; rows equal in all of them follow each other in any order.

    Rows are sorted over ranges and stored with their place in their task, tasks' rows are counted, and each task's first
    number is added to its rows' places. Only the counts, one for each task, meet in one task.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = spread.withColumns({"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    placed = stored(placed, f"{work_dir(rows.sparkSession, 'numbered')}/rows")
    counts = placed.groupBy("_task").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_first"))  # a row for each task
    return placed.join(F.broadcast(first), "_task").withColumn(name, F.col("_first") + F.col("_place") + start).drop("_task", "_place", "_first")
