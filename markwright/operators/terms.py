"""Many terms looked for in many texts at once, as plain substrings.

A term is filed under the rarest of its grams, runs of 8, 4, 2 or 1 bytes, whichever is the longest that fits. The grams
at all places of a text are looked up together: first in a bitmap of hashes, what passes in the sorted grams. Only where a
gram is found the terms filed under it are tried, first by their first and last gram, then, if they are longer than two
grams, byte by byte. The work is in proportion to the text and what is found in it, not to the number of terms, and no
text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of terms that are sent to the tasks at once; a longer list takes as many passes over the texts as it fills.
BUDGET = 64 << 20
#: Bytes of text that are searched at once; a longer text is searched in windows that overlap by a term.
PIECE = 1 << 20
WIDTHS = (8, 4, 2, 1)
BITS = 22


class Filed(NamedTuple):
    """The terms of one gram width: their numbers in the list, sorted by the gram they are filed under."""

    width: int
    grams: np.ndarray
    starts: np.ndarray
    term: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    bitmap: np.ndarray


def grams_of(data: bytes, width: int) -> np.ndarray:
    """The gram that begins at each byte, as a number; the text counts as continued by zeros."""
    padded, n = data + bytes(2 * width), len(data)
    out = np.empty(-(-n // width) * width, dtype=np.uint64)
    for k in range(width):
        out[k::width] = np.frombuffer(padded, dtype=f"<u{width}", offset=k, count=len(out) // width)
    return out[:n]


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def file_terms(terms: list[bytes]) -> list[Filed]:
    out = []
    sizes = np.array([len(t) for t in terms])
    for width, past in zip(WIDTHS, (1 << 62, *WIDTHS), strict=False):
        number = np.flatnonzero((sizes >= width) & (sizes < past))
        if not len(number):
            continue
        size = sizes[number]
        grams = grams_of(b"".join(terms[i] for i in number), width)
        ends = np.cumsum(size)
        begins = ends - size
        # How often a gram stands in the terms; one that would reach into the next term is no choice.
        _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
        often = count[place].astype(np.int64)
        inside = np.ones(len(grams), dtype=bool)
        for k in range(1, width):
            inside[ends - k] = False
        often[~inside] = 1 << 40
        least = np.minimum.reduceat(often, begins)
        is_least = np.flatnonzero(often == np.repeat(least, size))
        first = is_least[np.searchsorted(is_least, begins)]
        order = np.argsort(grams[first], kind="stable")
        distinct, starts = np.unique(grams[first][order], return_index=True)
        bitmap = np.zeros(1 << BITS, dtype=bool)
        bitmap[_slot(distinct)] = True
        out.append(Filed(width, distinct, np.append(starts, len(order)), number[order], (first - begins)[order], size[order], grams[begins][order], grams[ends - width][order], bitmap))
    return out


def pieces(texts: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(rows, bytes, offsets): runs of texts of about PIECE bytes, or a window of a longer one."""
    lo = 0
    while lo < len(texts):
        if len(texts[lo]) > 2 * PIECE:
            for at in range(0, len(texts[lo]), PIECE):
                window = texts[lo][at : at + PIECE + overlap]
                yield np.array([lo]), window, np.array([0, len(window)])
            lo += 1
            continue
        hi, n = lo, 0
        while hi < len(texts) and n <= PIECE and len(texts[hi]) <= 2 * PIECE:
            n += len(texts[hi])
            hi += 1
        yield np.arange(lo, hi), b"".join(texts[lo:hi]), np.append(0, np.cumsum([len(t) for t in texts[lo:hi]]))
        lo = hi


def find_terms(texts: list[bytes], terms: list[bytes], filed: list[Filed]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the term), ascending and each pair once, for the terms that the texts hold."""
    longest = max((len(t) for t in terms), default=1)
    found = [np.zeros(0, dtype=np.int64)]
    for rows, data, offsets in pieces(texts, longest - 1):
        for f in filed:
            grams = grams_of(data, f.width)
            at = np.flatnonzero(f.bitmap[_slot(grams)])
            place = np.minimum(np.searchsorted(f.grams, grams[at]), len(f.grams) - 1)
            at, place = (x[f.grams[place] == grams[at]] for x in (at, place))
            many = f.starts[place + 1] - f.starts[place]
            ends = np.cumsum(many)
            which = np.repeat(f.starts[place] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            at = np.repeat(at, many)
            begin, end = at - f.offset[which], at - f.offset[which] + f.size[which]
            row = np.searchsorted(offsets, at, side="right") - 1
            fits = (begin >= offsets[row]) & (end <= offsets[row + 1])
            begin, end, which, row = (x[fits] for x in (begin, end, which, row))
            fits = (grams[begin] == f.head[which]) & (grams[end - f.width] == f.tail[which])
            begin, end, which, row = (x[fits] for x in (begin, end, which, row))
            pair = rows[row].astype(np.int64) * len(terms) + f.term[which]
            short = f.size[which] <= 2 * f.width
            found.append(np.unique(pair[short]))
            sure = set()
            for b, e, p in zip(begin[~short].tolist(), end[~short].tolist(), pair[~short].tolist(), strict=True):
                if p not in sure and data[b:e] == terms[p % len(terms)]:
                    sure.add(p)
            found.append(np.array(sorted(sure), dtype=np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs // max(len(terms), 1), pairs % max(len(terms), 1)


def scan_term_table(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(key, ord, term) for every row of terms, (ord, term), that a text holds, case-sensitive.

    The list is collected in parts of about `budget` bytes, each for a pass over the texts. A null text holds nothing, a null
    term is held by none, the empty term by every text; terms that repeat are each found.
    """
    listed = terms.where("term IS NOT NULL").select("ord", "term")
    size = listed.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    parts = max(1, -(-size // budget))
    ready = docs.where(F.col(text).isNotNull()).select(key, F.col(text).cast("binary"))
    kind, ord_kind = docs.schema[key].dataType, terms.schema["ord"].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ord", ord_kind), T.StructField("term", T.StringType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for part in range(parts):
        some = listed.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).orderBy("ord", "term").toArrow().combine_chunks()
        if some.num_rows:
            out = out.union(ready.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(some), key), schema))
    return out


def _search(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ords, names = (c.combine_chunks() for c in shared.value.columns)
        terms = [t.encode() for t in names.to_pylist()]
        empty = np.array([i for i, t in enumerate(terms) if not t], dtype=np.int64)
        filed = file_terms(terms)
        for batch in batches:
            row, term = find_terms(batch.column(1).to_pylist(), terms, filed)
            n = np.arange(len(batch))
            row, term = np.concatenate([row, np.repeat(n, len(empty))]), np.concatenate([term, np.tile(empty, len(n))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ords.take(pa.array(term)), names.take(pa.array(term))], [key, "ord", "term"])

    return run
