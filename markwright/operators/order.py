"""Row numbers over a whole table or heavy groups, without a task that sees all of it; broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.sources.files import cut


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """df marked for broadcast if its rows, which are counted, are within the limit; else the choice of join is Spark's."""
    return F.broadcast(df) if df.count() <= limit else df


def numbered(df: DataFrame, order: list[Column], group: str | None = None, name: str = "place") -> DataFrame:
    """df with the row number in this order, within each group if one is named.

    Rows are dealt by ranges of group and order, numbered inside a range, and raised by the rows of the ranges before.
    """
    by = [group] if group else []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *map(F.col, by), *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n"))
    starts = starts.select(*(F.col(c).alias("__group") for c in by), F.col("__part").alias("__range"), "__start")
    inside = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    same = F.col("__part") == F.col("__range")
    if group:
        same &= F.col(group).eqNullSafe(F.col("__group"))
    return inside.join(starts, same).select(*df.columns, (F.col("__row") + F.col("__start")).cast("int").alias(name))
