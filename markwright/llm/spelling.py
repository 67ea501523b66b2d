"""Spelling variant grouping by a reduced alphabet.

Letters are hashed to a few symbols, so that a word becomes a reduced word of the same length. Two words one edit apart
have reduced words at most one edit apart; so the full one-edit neighbourhood of each distinct reduced word, itself
included, is generated and joined with the reduced vocabulary, and each pair of words met that way is checked on the
original strings inside the join. A reduced word is named by a polynomial hash, from which the hashes of its neighbours
follow without building them; reduced words that share a hash only bring more pairs to check.

The number of symbols follows the size of the vocabulary, so that the words of a key stay few while the vocabulary
grows. Forms are then followed to their roots by pointer doubling: counts grow at least fivefold from form to form, so
there are no cycles and few rounds.

Defined cases: a null text has no words; a null doc_id hashes as an empty string; rows that repeat a doc_id all count; a
word of any length has its whole neighbourhood looked for; extra columns are ignored; empty tables, or tables without a
word that is frequent enough, give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import cut, partitions
from markwright.llm.vectors import BASE, PLACES, mix, powers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Keys of a neighbourhood block that are made at once.
CELLS = 1 << 20
#: What a key holds of the length.
TAIL = PLACES[15:]


def lower_ascii(s: Column) -> Column:
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, thin: int = 199) -> DataFrame:
    """(word, n): runs of letters, of which one in `thin`, chosen by its hash with the doc_id, lacks a code point."""
    # A shorter run can't give a word that is long enough; a run is matched from its first letter or not at all.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % thin == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    counts = runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def symbols_for(words: int) -> int:
    """Symbols enough for some 64 words or fewer to each reduced word of the least length, were words spread evenly; four at least."""
    return max(4, int(np.ceil((max(words, 1) / 64) ** (1 / LEAST_LENGTH) - 1e-9)))


def alphabet(symbols: int) -> np.ndarray:
    """The symbol of each code point below 256."""
    return np.array([zlib.crc32(chr(c).encode()) % symbols for c in range(256)], dtype=np.uint8)


def reduce_words(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds to (word, n) the reduced word, as bytes, and its key."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        symbols = table[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        reduced = [symbols[e - len(w) : e] for w, e in zip(words, ends, strict=True)]
        keys = np.array([key_of(r) for r in reduced], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in reduced], pa.binary()), pa.array(keys)], ["word", "n", "reduced", "key"])


def key_of(reduced: np.ndarray) -> np.uint64:
    up, _ = powers(len(reduced))
    return mix(((reduced.astype(np.uint64) + np.uint64(1)) * up[: len(reduced)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(reduced)) * TAIL)[0]


def neighbour_keys(words: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key), without repeats, of each row's word itself and all reduced words one edit away; words is a matrix of symbols."""
    m, n = words.shape
    up, down = powers(n + 1)
    values = words.astype(np.uint64) + np.uint64(1)
    before = np.zeros((m, n + 1), dtype=np.uint64)
    np.cumsum(values * up[:n], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    each = np.arange(1, symbols + 1, dtype=np.uint64)
    deleted = before[:, :-1] + (whole - before[:, 1:]) * down[1] + np.uint64(n - 1) * TAIL
    replaced = (whole - values * up[:n])[:, :, None] + each * up[:n, None] + np.uint64(n) * TAIL
    inserted = (before + (whole - before) * np.uint64(BASE))[:, :, None] + each * up[: n + 1, None] + np.uint64(n + 1) * TAIL
    keys = np.sort(mix(np.concatenate([deleted, replaced.reshape(m, -1), inserted.reshape(m, -1)], axis=1)), axis=1)
    first = np.ones(keys.shape, dtype=bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(first)[0], keys[first]


def neighbourhoods(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """(key, near) for (key, reduced): near are the keys of the reduced word's neighbourhood."""
    for batch in batches:
        keys, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            step = max(1, CELLS // int((2 * size + 1) * symbols + size))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                block = np.frombuffer(b"".join(words[i] for i in some), dtype=np.uint8).reshape(len(some), size)
                row, near = neighbour_keys(block, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(keys[some[row]]), pa.array(near.view(np.int64))], ["key", "near"])


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words that differ by one inserted, deleted or replaced code point.

    words has one row a word, (word, n). Pairs are compared inside the last join, only those found come out of it.
    """
    symbols = symbols or symbols_for(words.count())
    table = alphabet(symbols)
    reduced = cut(words.select("word", "n").repartition(partitions(words.sparkSession)).mapInArrow(lambda batches: reduce_words(batches, table), "word string, n long, reduced binary, key long"))
    around = reduced.select("key", "reduced").distinct().mapInArrow(lambda batches: neighbourhoods(batches, symbols), "key long, near long")
    others = reduced.select(F.col("key").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = around.join(others, "near").select("key", "other", "other_n")
    # The lengths are cheap to compare and most pairs differ in more than one place.
    apart = F.levenshtein("word", "other", 1) == 1
    return reduced.join(met, (reduced["key"] == met["key"]) & apart).select("word", F.col("other").alias("near"), F.col("other_n").alias("near_n"))


def group_variants(docs: DataFrame, ratio: int = RATIO, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the documents' texts."""
    words = cut(count_words(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    near = near_pairs(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    is_form = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    found = cut(joined.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")))
    roots = follow(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(links: DataFrame) -> DataFrame:
    """(word, root): each word's link followed to the last; links, (word, root), have one row a word and no cycles.

    Each round doubles the steps taken and is written to the shared folder.
    """
    links = cut(links)
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("__further"))
        step = cut(links.join(further, "root", "left").select("word", F.coalesce("__further", "root").alias("root"), F.col("__further").isNotNull().alias("__moved")))
        links = step.select("word", "root")
        if step.where("__moved").isEmpty():
            return links
