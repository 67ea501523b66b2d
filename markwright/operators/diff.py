"""Differences between two versions of an answer sheet, and between two images. The cores need numpy, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.functions.text import trim_end, unix_newlines

def _shared(left: list[str], right: list[str]) -> int:
    """How many lines both start with."""
    start = 0
    while start < min(len(left), len(right)) and left[start] == right[start]:
        start += 1
    return start


#: A line's mask is kept if it stands in more than one of so many lines; others are made when they are needed.
COMMON = 256


def _masks(lines: list[str]):
    """Gives the set of places at which a line stands, counted from the last line, as the bits of a number."""
    places: dict[str, list[int]] = {}
    for i, line in enumerate(reversed(lines)):
        places.setdefault(line, []).append(i)
    size, known = len(lines) // 8 + 1, {}

    def mask(line: str) -> int:
        at = places.get(line, ())
        if len(at) == 1:
            return 1 << at[0]
        if line in known or not at:
            return known.get(line, 0)
        bits = bytearray(size)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        number = int.from_bytes(bits, "little")
        if len(at) * COMMON > len(lines):
            known[line] = number
        return number

    return mask


def script(left: list[str], right: list[str]) -> list[str]:
    """The edit script by longest common subsequence; on a tie the addition comes first.

    A row of the table of lengths is held as one number, with a bit for each column that says whether the length there is
    that of the next column; rows follow from each other, from the last line to the first, by an addition and a few bit
    operations on whole numbers, 64 columns to a machine word. Where two lines differ, that bit alone decides: if it is
    set, leaving out the right line costs nothing, so it is an addition; else the left line goes. Every so many rows one is
    kept and the rows between are made again, so that memory grows with the lines and the root of the rows.
    """
    start = _shared(left, right)
    a, b = left[start:], right[start:]
    n, mask = len(b), _masks(b)
    full = (1 << n) - 1

    def row_above(row: int, line: str) -> int:
        met = row & mask(line)
        return (row + met | row - met) & full if met else row

    block = max(1, int(len(a) ** 0.5))
    row, kept = full, {}
    for i in range(len(a) - 1, -1, -1):
        if (i + 1) % block == 0 or i + 1 == len(a):
            kept[i + 1] = row
        row = row_above(row, a[i])
    out = [f" {v}" for v in left[:start]]
    j = 0
    for top in range(0, len(a), block):
        end = min(top + block, len(a))
        row, rows = kept.pop(end), []
        for i in range(end - 1, top - 1, -1):
            row = row_above(row, a[i])
            rows.append(row)
        for i in range(top, end):
            same = rows.pop().to_bytes(n // 8 + 1, "little")
            while j < n and b[j] != a[i] and same[n - 1 - j >> 3] >> (n - 1 - j & 7) & 1:
                out.append(f"+{b[j]}")
                j += 1
            if j < n and b[j] == a[i]:
                out.append(f" {a[i]}")
                j += 1
            else:
                out.append(f"-{a[i]}")
    return [*out, *(f"+{v}" for v in b[j:])]


def line_diff(pairs: DataFrame, key: str = "pair_id", max_cells: int | None = None, *keep: str) -> DataFrame:
    """(key, keep..., lines, added, removed, too_large) for (key, keep..., before_text, after_text).

    Texts are compared with CRLF and CR as LF and without white space at the end. Equal texts never reach Python. Work is
    dealt out by the estimated number of cells, so that a few long pairs do not meet in one task. Every pair is diffed;
    only if max_cells is given, pairs of more line pairs than that, after what both start with, are reported as too large.
    """
    clean = lambda c: trim_end(unix_newlines(F.coalesce(c, F.lit(""))))
    ready = pairs.select(key, *keep, clean("before_text").alias("a"), clean("after_text").alias("b"))
    same = F.col("a") == F.col("b")
    names = [key, *keep]
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                left, right = a.split("\n"), b.split("\n")
                start = _shared(left, right)
                large = max_cells is not None and (len(left) - start) * (len(right) - start) > max_cells
                lines = None if large else script(left, right)
                rows.append((lines, None if large else sum(x[0] == "+" for x in lines), None if large else sum(x[0] == "-" for x in lines), large))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.string()), pa.int64(), pa.int64(), pa.bool_()), strict=True))], [*names, "lines", "added", "removed", "too_large"])

    differ = ready.where(~same).repartition(F.pmod(F.xxhash64(key), F.lit(1 << 16)))
    changed = differ.mapInArrow(run, f"{kinds}, lines array<string>, added long, removed long, too_large boolean")
    equal = ready.where(same).select(*names, F.transform(F.split("a", "\n", -1), lambda x: F.concat(F.lit(" "), x)).alias("lines"), F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("removed"), F.lit(False).alias("too_large"))
    return changed.unionByName(equal)


def diff_report(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, before_sha256, after_sha256, changed, added, removed): hashes of the raw texts, the flag on the cleaned ones.

    The hashes go along with the texts that are diffed, so that only changed texts are shuffled, once.
    """
    hashed = pairs.withColumns({"before_sha256": F.sha2("before_text", 256), "after_sha256": F.sha2("after_text", 256)})
    found = line_diff(hashed, key, None, "before_sha256", "after_sha256")
    return found.select(key, "before_sha256", "after_sha256", ((F.col("added") > 0) | (F.col("removed") > 0)).alias("changed"), "added", "removed")


def pixel_diff(pairs: DataFrame, key: str, max_ratio: float = 0.005) -> DataFrame:
    """(key, comparable, differing, ratio, passed) for (key, before, after): arrays of channel values, four to a pixel."""
    a, b = F.col("before"), F.col("after")
    comparable = (F.size(a) == F.size(b)) & (F.size(a) % 4 == 0)
    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 4).cast("int") - 1), lambda i: F.slice(a, i * 4 + 1, F.lit(4)) != F.slice(b, i * 4 + 1, F.lit(4)))
    differing = F.when(comparable & (F.size(a) > 0), F.size(F.filter(pixels, lambda p: p))).when(comparable, 0)
    ratio = F.when(comparable, differing / F.greatest(F.size(a) / 4, F.lit(1)))
    found = pairs.select(key, F.coalesce(comparable, F.lit(False)).alias("comparable"), differing.cast("long").alias("differing"), ratio.alias("ratio"))
    return found.select("*", (F.col("comparable") & (F.col("ratio") <= max_ratio)).alias("passed"))


def image_diff(pairs: DataFrame, key: str, max_ratio: float = 0.005) -> DataFrame:
    """The same for images as Spark's image source reads them: (key, before, after) with structs of width, height, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y))
                n.append(int((p != q).reshape(-1, 4).any(axis=1).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(3)], [key, "differing", "pixels"])

    kind = pairs.schema[key].dataType.simpleString()
    same = (F.col("before.width") == F.col("after.width")) & (F.col("before.height") == F.col("after.height")) & (F.length("before.data") == F.length("after.data")) & (F.length("before.data") % 4 == 0)
    ready = pairs.where(same).select(key, F.col("before.data"), F.col("after.data").alias("other"), (F.length("before.data") / 4).cast("long").alias("pixels"))
    found = ready.mapInArrow(run, f"{key} {kind}, differing long, pixels long").withColumn("ratio", F.col("differing") / F.greatest("pixels", F.lit(1)))
    rest = pairs.where(~F.coalesce(same, F.lit(False))).select(key, F.lit(False).alias("comparable"), F.lit(None).cast("long").alias("differing"), F.lit(None).cast("double").alias("ratio"), F.lit(False).alias("passed"))
    return found.select(key, F.lit(True).alias("comparable"), "differing", "ratio", (F.col("ratio") <= max_ratio).alias("passed")).unionByName(rest)
