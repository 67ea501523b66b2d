"""Benchmark decontamination: test items inside long documents, by size-partitioned MinHash containment search.

A document may be thousands of times longer than a test item, so the similarity of their sets says little; what counts
is the share of the item's word shingles that the document holds. Items are partitioned by their number of distinct
shingles n. An item's MinHash sketch is its smallest shingle hashes; in a partition with at most n shingles it has
floor((1 - threshold) * n) + 1 of them, since a document that holds the threshold share of an item's shingles misses at
most floor((1 - threshold) * n), and so holds at least one of the sketch. A document's shingle hashes are looked up in
the sketches, which leaves few candidates and loses none; they are confirmed by containment of the shingles themselves.
Sketches within SKETCH_ROWS rows are broadcast; of more, a bitmap is, and only shingles that it lets through are shuffled.

Shingles are sequences of `k` words with A-Z in lower case; an item with fewer words is one shingle of all its words.

Defined cases: items without words match nothing; null and blank texts hold nothing; rows that repeat an id count as
one document or item if their texts agree, else each text is judged and the greatest containment counts; rows without an
id are not reported by find_items, but drop_contaminated judges them too; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import BROADCAST_ROWS, cut, small

SPLIT = r"[\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """The words of a text with A-Z in lower case; null gives no words."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, SPLIT), lambda w: w != "")


def shingles(w: str, size: Column) -> Column:
    """All sequences of `size` words of the array column, joined by spaces; none if there are fewer words."""
    places = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i, size), " "))


def shingle_hashes(w: Column, m: int) -> Column:
    """Hashes of all sequences of m words of the array column."""
    places = F.when(F.size(w) >= m, F.sequence(F.lit(0), F.size(w) - m)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(m))))


def _text_hash(m: int) -> Callable[[Column], Column]:
    """The hash of a shingle of m words given as text, as shingle_hashes has it."""
    return lambda s: F.xxhash64(*(F.get(F.split(s, " "), F.lit(j)) for j in range(m)))


def item_table(benchmark: DataFrame, k: int) -> DataFrame:
    """item_id, m (words in a shingle: k, or all of a shorter item), shingles (distinct texts), n."""
    items = benchmark.select("item_id", words("text").alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    items = items.withColumn("m", F.least(F.size("w"), F.lit(k)))
    items = items.select("item_id", "m", F.array_distinct(shingles("w", F.col("m"))).alias("shingles")).distinct()
    return items.withColumn("n", F.size("shingles"))


def sketches(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(item_id, m, hash): the smallest hashes of each item, as many as the largest item of its size partition needs.

    Partitions double in size: 1, 2-3, 4-7, 8-15 and so on.
    """
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    needed = (F.floor(top * (1 - threshold) + 1e-9) + 1).cast("int")
    by_length = F.lit(None).cast("array<bigint>")
    for m in range(1, k + 1):
        by_length = F.when(F.col("m") == m, F.transform("shingles", _text_hash(m))).otherwise(by_length)
    hashed = F.array_sort(by_length)
    return items.select("item_id", "m", F.explode(F.slice(hashed, F.lit(1), needed)).alias("hash"))


#: Beyond this many rows of sketches they are not broadcast; a bitmap of their hashes is.
SKETCH_ROWS = BROADCAST_ROWS

#: A page of the bitmap has 2**PAGE numbers of 64 bits; a bitmap has 2**MOST bits (64 MB) at most.
PAGE, MOST = 10, 29


def _place(h: Column, bits: int) -> tuple[Column, Column, Column]:
    """Page, number within the page and bit of a hash in a bitmap of 2**bits bits."""
    right = lambda c, by: F.call_function("shiftright", c, F.lit(by))
    at = h.bitwiseAND(F.lit((1 << bits) - 1))
    word = right(at, 6)
    return right(word, PAGE).cast("int"), word.bitwiseAND(F.lit((1 << PAGE) - 1)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def with_sketch_hash(found: DataFrame, sketch: DataFrame, n_sketch: int) -> DataFrame:
    """The rows of `found` whose hash may be in the sketches: all of those that are, and about one in 16 of the others.

    The bitmap has some 16 bits for each row of the sketches, until it has 64 MB; from there on it lets more through, but
    loses none. Its pages are joined by broadcast, so that shingles are left out before they are shuffled.
    """
    bits = min(MOST, max(PAGE + 6, (16 * n_sketch - 1).bit_length()))
    page, word, bit = _place(F.col("hash"), bits)
    marked = sketch.select(page.alias("page"), word.alias("word"), bit.alias("bit")).groupBy("page", "word").agg(F.bit_or("bit").alias("bit"))
    empty = found.sparkSession.range(1 << (bits - PAGE - 6)).select(F.col("id").cast("int").alias("page"), F.explode(F.sequence(F.lit(0), F.lit((1 << PAGE) - 1))).alias("word"), F.lit(0).cast("long").alias("bit"))
    full = marked.unionByName(empty).groupBy("page", "word").agg(F.bit_or("bit").alias("bit"))
    pages = full.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("__words"))
    pages = cut(pages.select(F.col("page").alias("__page"), "__words"))
    held = (F.col("__page") == page) & (F.get("__words", word).bitwiseAND(bit) != 0)
    return found.join(F.broadcast(pages), held).select(*found.columns)


def find_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item (distinct shingles of the item), n_shared, containment, for containments from the threshold."""
    items = cut(item_table(benchmark, k))
    n_items = items.count()
    sketch = cut(sketches(items, k, threshold))
    n_sketch = sketch.count()
    lengths = sorted(r["m"] for r in items.select("m").distinct().collect())
    base = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    worded = base.select("doc_id", words("text").alias("w"))
    candidates = None
    for m in lengths:
        found = worded.select("doc_id", F.explode(shingle_hashes(F.col("w"), m)).alias("hash"))
        own = sketch.where(F.col("m") == m).select("item_id", "hash")
        if n_sketch > SKETCH_ROWS:
            found = with_sketch_hash(found, own, n_sketch).distinct()
        found = found.join(small(own, n_sketch, SKETCH_ROWS), "hash").select("doc_id", "item_id")
        candidates = found if candidates is None else candidates.union(found)
    if candidates is None:
        return base.limit(0).select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    candidates = cut(candidates.distinct().groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids")))
    texts = base.join(small(candidates), "doc_id").select("doc_id", words("text").alias("w"), "item_ids")
    pairs = None
    for m in lengths:
        held = texts.select("doc_id", F.array_distinct(shingles("w", F.lit(m))).alias("held"), F.explode("item_ids").alias("item_id"))
        held = held.join(small(items.where(F.col("m") == m), n_items), "item_id")
        held = held.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), F.size(F.array_intersect("shingles", "held")).cast("long").alias("n_shared"))
        pairs = held if pairs is None else pairs.union(held)
    pairs = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)
    best = F.max(F.struct("containment", "n_item", "n_shared")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item; columns as they come.

    Texts are told apart by their hash, not by doc_id, so that rows without an id, or with one that repeats, are each
    judged by their own text.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    gone = cut(find_items(docs.select(key.alias("doc_id"), "text"), benchmark, k, threshold).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(small(gone), key == F.col("__gone"), "left_anti").select(*docs.columns)


#: DuckDB's version of find_items with k = 5 and threshold 0.8, by shingles alone.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda p: array_to_string(w[p : p + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
lengths AS (SELECT DISTINCT m FROM i),
h AS (SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda p: array_to_string(w[p : p + m - 1], ' '))) AS s FROM d, lengths WHERE len(w) >= m)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / n_item AS containment
FROM h JOIN i USING (m, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8
"""
