"""Mixing sources to target weights.

Every document gets a hash-random key. The keys of a source are cut into ranges of equal width, so a source that holds a
third of all rows is spread over as many ranges as it needs. Sizes are summed by range, ranges are added up within their
source, and a running sum inside each range completes a distributed prefix sum in key order. A source takes whole
epochs as often as its target holds them; the last epoch is cut where the budget ends, within the document that crosses
it.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; rows that repeat a doc_id
are separate documents, ordered by size among themselves; a source without words has target 0; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import cut, small

#: Words of a text: maximal runs of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of keys in a source: the first three of the hexadecimal digits of the key.
DIGITS = 3

#: Targets from the sizes of the sources (view by_source: source, size). Shared by Spark and the oracle.
TARGETS_SQL = """
ranked AS (SELECT source, size, row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) AS pos FROM by_source),
weighed AS (SELECT source, size, CASE (pos - 1) % {n} {cases} END AS weight FROM ranked),
capped AS (SELECT source, size, weight, {cap} * size AS cap, {cap} * size / weight AS fill FROM weighed),
filled AS (
  SELECT source, size, weight, cap, fill,
    coalesce(sum(cap) OVER (ORDER BY fill, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY fill, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    sum(size) OVER () AS all_sizes
  FROM capped),
levels AS (SELECT *, ({share} * all_sizes - below) / open_weight AS level FROM filled),
chosen AS (SELECT max(CASE WHEN level <= fill THEN level END) AS level FROM levels),
targets AS (SELECT source, size AS source_size,
    CASE WHEN chosen.level IS NULL OR cap <= weight * chosen.level THEN cap ELSE weight * chosen.level END AS target
  FROM capped, chosen)
"""


def targets_sql(weights: tuple[float, ...], share: float, cap: float) -> str:
    """CTEs that end in `targets`: shares by weight, held at cap times a source's size, the excess reshared by weight.

    Sorted by the level at which a source is full, the sources that stay open are a suffix; the level is the first, and
    so the greatest, at which the rest of the words, shared by weight among the open sources, fills none of them.
    """
    cases = " ".join(f"WHEN {i} THEN CAST({float(w)} AS DOUBLE)" for i, w in enumerate(weights))
    return TARGETS_SQL.format(n=len(weights), cases=cases, share=f"CAST({float(share)} AS DOUBLE)", cap=f"CAST({float(cap)} AS DOUBLE)")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    With carry, each row of docs comes along whole as the struct `row`, and settles the order of rows with equal doc_id and size.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    sized = cut(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("key", 1, DIGITS)))
    by_part = cut(sized.groupBy("source", "part").agg(F.sum("size").alias("size")))
    by_source = by_part.groupBy("source").agg(F.sum("size").alias("size"))
    targets = cut(spark.sql(f"WITH by_source AS (SELECT * FROM {{s}}), {targets_sql(weights, share, cap)} SELECT * FROM targets", s=by_source))
    starts = by_part.select("source", "part", F.expr("sum(size) OVER (PARTITION BY source ORDER BY part) - size").alias("start"))
    starts = starts.join(small(targets), starts.source.eqNullSafe(targets.source)).select(starts.source, "part", "start", "source_size", "target")
    starts = cut(starts)
    tie = ", xxhash64(row)" if carry else ""
    inside = sized.withColumn("before", F.expr(f"sum(size) OVER (PARTITION BY source, part ORDER BY key, doc_id, size{tie} ROWS UNBOUNDED PRECEDING) - size"))
    joined = inside.join(small(starts).alias("s"), inside.source.eqNullSafe(F.col("s.source")) & (inside.part == F.col("s.part")))
    whole = F.expr("CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT)")
    rest = F.expr("CAST(floor(target) AS BIGINT)") - whole * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("before")))
    return joined.select("doc_id", inside.source, "size", "source_size", "target", (whole * F.col("size") + last).cast("long").alias("taken"), *(["row"] if carry else []))


#: DuckDB's version of mix_sources with the weights of the query, over a view `documents`.
ORACLE = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source),
{targets_sql((5.0, 2.0, 1.0), 1.5, 2.0)},
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM placed
"""
