"""Vectorised work on the UTF-8 bytes of many texts at once, for use inside mapInArrow tasks.

Texts are taken in pieces of about a megabyte, so that a task's memory does not depend on the length of its partition.
Hashes are polynomials modulo 2**64 over prefix sums, finished by a 64-bit mixer; they are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers for the places of a shingle; any odd numbers do.
PLACES = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1 for i in range(16)], dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, times BASE**-start, are hashes of substrings."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def sub_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def text_pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows of about `limit` bytes.

    A row longer than the limit comes alone and whole. The column has no nulls.
    """
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word; a word never crosses rows."""
    n = len(data)
    solid = ~IS_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~solid[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | first[:n]))
    ends = np.flatnonzero(solid & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word with A-Z in lower case, and the word's row."""
    starts, ends, row = word_bounds(data, offsets)
    return sub_hash(prefix_hash(LOWER[data]), starts, ends), row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; with none, empty."""
    words, row = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    n_words = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(n_words)
    total = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * PLACES[j]
    total = mix(total)
    out = []
    for i in range(n_rows):
        m, end = int(n_words[i]), int(ends[i])
        if m >= k:
            out.append(np.unique(total[end - m : end - k + 1]))
        elif m:
            out.append(mix((words[end - m : end] * PLACES[:m]).sum(keepdims=True, dtype=np.uint64) + PLACES[15:] * np.full(1, m, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def list_array(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1)))
