"""What the training-data operators share: reading tables, cutting lineage, bounded samples, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markwright.sources.files import cut, scratch, shared_dir  # noqa: F401

#: A side of a join is broadcast only if it has been counted and holds no more rows than this.
BROADCAST_ROWS = 200_000

#: Words are maximal runs of characters other than space and \x09-\x0D.
SPACES = " \\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if its row count is within the limit; else leave the choice of join to Spark."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is sized to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for rows no model may learn labels from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def hash_unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


def stratified(df: DataFrame, by: str, bound: int) -> DataFrame:
    """A repeatable sample of at most `bound` rows: from each value of `by` an even share, or all its rows if they are fewer.

    Rows stand in the order of a hash of all their columns, whatever ids they share or lack, and copies of a row count as
    one. With more values than the bound, one row of each of the most frequent ones is taken. Null values are left out.
    """
    place = F.xxhash64(*df.columns, F.lit(by))
    counts = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__value")).agg(F.approx_count_distinct(place).alias("__n"))
    counts = cut(counts.orderBy(F.desc("__n"), "__value").limit(bound))
    n = counts.count()
    if not n:
        return df.limit(0)
    share = bound // n
    # Some more than the share, so that it is reached; the hash is uniform over rows that differ, which are counted roughly.
    unit = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    near = df.join(small(counts, n), F.col(by) == F.col("__value")).where(unit < (1.3 * share + 8 * share**0.5 + 16) / F.col("__n"))
    near = cut(near.select(*df.columns, place.alias("__place")).dropDuplicates([by, "__place"]))
    first = near.select(by, "__place", F.row_number().over(Window.partitionBy(by).orderBy("__place")).alias("__row")).where(F.col("__row") <= share)
    return near.join(small(first.select(by, "__place")), [by, "__place"], "left_semi").select(*df.columns)
