"""Dense numbers in a given order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written


def numbered(df: DataFrame, order: list[str | Column], name: str = "place", first: int = 1) -> DataFrame:
    """``df`` with ``name``: the rows' numbers by ``order``, without gaps, from ``first``.

    Rows go to ranges of the order, the ranges are counted, and a row's number is that within its range after all of the ranges before. What the driver sees is one row for
    each range, as many as the session's shuffles have; no task holds more than a range. The order should tell rows apart; equal rows get their numbers as they come.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, seen = [], first
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], seen))
        seen += r["count"]
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    return ranged.join(offsets, "_range").withColumn(name, F.col("_start") + within).select(*df.columns, name)
