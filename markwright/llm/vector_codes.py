"""Vector code compression: product codes over integer components, with per-dimension value dictionaries.

Vectors become integers and are cut into equal parts; each part is named by the nearest of up to 256 codebook entries.
Entries start as the parts of the first vectors and are moved to the mean of their parts, rounded down, a fixed number of
times. A task looks at a batch of vectors by dimension: it lists the distinct integers there, tabulates their squared
differences to all entries once, and gets all distances of a part by gathers from those tables and additions. Tasks
return sums and counts by (part, entry, position), which Spark adds up; only the codebooks, whose size depends on the
number of entries and the dimension, are held by the driver and sent to the tasks.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; integers beyond 2**27
either way are taken as 2**27 (errors stay within a long up to 64 dimensions of that size); vectors shorter than the
longest, or whose length the number of parts does not divide, count as continued by zeros; of rows that repeat a vec_id
the one with the smaller integers comes first, all are coded; rows without a vec_id come last; with fewer rows than
entries the codebook is that much smaller; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.llm.common import cut, small

MOST = 1 << 27
#: Rows whose distances to all entries are held at once; a megabyte for 256 entries.
ROWS = 1024


def integers(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(__key, __label, __x): the kept rows with their integer components."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return df.where(x.isNotNull() & ~bad).select(F.col(key).alias("__key"), F.col(label).alias("__label"), whole.alias("__x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def value_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers of a dimension, ascending, and each row's place among them."""
    low, high = int(values.min()), int(values.max())
    if high - low > 1 << 20:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(high - low + 1, dtype=bool)
    seen[values - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a part the entry at the least squared distance, the first of equals, and that distance."""
    n, width = part.shape
    entries = len(book)
    reach = max(int(np.abs(part.astype(np.int64)).max(initial=0)), int(np.abs(book).max(initial=0))) * 2
    kind = np.int32 if reach * reach * width < 1 << 31 else np.int64
    tables, codes = [], []
    for j in range(width):
        distinct, code = value_codes(part[:, j])
        apart = (distinct.astype(np.int64)[:, None] - book[None, :, j]).astype(kind)
        tables.append(apart * apart)
        codes.append(code)
    best, least = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    total, more = np.empty((min(ROWS, n), entries), dtype=kind), np.empty((min(ROWS, n), entries), dtype=kind)
    for lo in range(0, n, ROWS):
        m = min(ROWS, n - lo)
        total[:m] = 0
        for table, code in zip(tables, codes, strict=True):
            np.take(table, code[lo : lo + m], axis=0, out=more[:m], mode="clip")
            total[:m] += more[:m]
        best[lo : lo + m] = total[:m].argmin(axis=1)
        least[lo : lo + m] = total[np.arange(m), best[lo : lo + m]]
    return best, least


def move(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry at the floored mean of the parts it is nearest to; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                if not len(part):
                    continue
                best, _ = nearest(part, books[p])
                count[p] += np.bincount(best, minlength=entries)
                for j in range(width):
                    total[p, :, j] += np.bincount(best, weights=part[:, j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(count)
        for j in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (p, e, np.full(len(p), j), total[p, e, j], count[p, e])], ["part", "entry", "position", "total", "n"])

    found = rows.select("__x").mapInArrow(sums, "part long, entry long, position long, total long, n long")
    found = found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    got = found.toArrow()  # at most parts x entries x width rows
    part, entry, position, total, n = (got.column(c).to_numpy() for c in ("part", "entry", "position", "total", "n"))
    out[part, entry, position] = total // n
    return out


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """((key, label, code array<int>, error long), codebooks as an array by part, entry, position)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rows = cut(integers(df, key, vector, label, scale))
    longest = rows.agg(F.max(F.size("__x"))).first()[0] or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.col("__key").asc_nulls_last(), "__x").limit(entries).select("__x").toArrow().column(0).combine_chunks()
    books = matrix(first, parts * width).astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if books.size else 0):
        books = move(rows, books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), parts * width)
            code, error = np.zeros((len(x), parts), dtype=np.int32), np.zeros(len(x), dtype=np.int64)
            for p in range(parts if len(x) else 0):
                code[:, p], least = nearest(x[:, p * width : (p + 1) * width], books[p])
                error += least
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32)), pa.array(code.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(error)], ["__key", "__label", "__code", "__error"])

    schema = T.StructType([rows.schema["__key"], rows.schema["__label"], T.StructField("__code", T.ArrayType(T.IntegerType())), T.StructField("__error", T.LongType())])
    return rows.mapInArrow(assign, schema).toDF(key, label, "code", "error"), books


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Rows of compress() with label_error, the error summed over the rows of the same label; null labels are one label."""
    sums = cut(coded.groupBy(F.col(label).alias("__same")).agg(F.sum("error").alias("label_error")))
    return coded.join(small(sums), F.col(label).eqNullSafe(F.col("__same"))).drop("__same")


def digests(coded: DataFrame, books: np.ndarray, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, code as hex digits, error, label_error, codebooks_sha256)."""
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return with_label_errors(cut(coded), label).select(key, code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """One round of the oracle: assignment a<i> by codebook b<i>, and the codebook after it."""
    return f"""
a{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, [d, entry]) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, b.entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d FROM p JOIN b{i} b USING (part, pos) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
  SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM p JOIN a{i} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos)),"""


#: For tables whose vectors have one length, which four divides, and whose ids do not repeat.
ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(e) // 4) AS part, (i - 1) % (len(e) // 4) AS pos, e[i] AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, entry, pos, CAST(x AS HUGEINT) AS x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 256) USING (vec_id)),
{"".join(map(_round, range(5)))}
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b4),
r AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id) CROSS JOIN s
"""
