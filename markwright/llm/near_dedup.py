"""MinHash near-duplicate detection with odd sketches.

One pass over the texts gives each document a MinHash sample, band keys cut from it, and an odd sketch: a parity bitmap
into which every (place, minimum) of the sample is folded, so that the population count of the XOR of two bitmaps
estimates in how many places two samples differ. Documents with equal shingle sets are collapsed first. Within each
band bucket the members are compared with one centre, then only members that are still in another component than the
rest of their bucket are compared further, so a bucket of near copies costs in proportion to its size. Pairs whose
bitmaps are too far apart are dropped, the others are confirmed on the full shingle sets, and components follow from
the confirmed links.

Two documents with similarity 0.8 share no band with probability (1 - 0.8**4)**28 < 4e-7, and the sketch bound loses
one with probability below 1e-6.

Defined cases: a null or blank text has an empty set and is linked with nothing; a text with fewer words than a shingle
has its whole word sequence as its only shingle; every row is a document of its own, also where rows share a doc_id (a
component is named by the smallest doc_id in it, so two components may have one name then); a row without a doc_id is
linked with nothing and has no component_id; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import cut, partitions, small
from markwright.llm.graph import components
from markwright.llm.vectors import list_array, mix, shingle_sets, text_pieces

#: What bands and sketch bounds are made for.
LEAST_PERCENT = 80
ROWS, BANDS, SKETCH_BITS = 4, 28, 512
SAMPLE = ROWS * BANDS
#: Bitmaps of documents with similarity 0.8 or more differ in fewer bits than this: 46 places of 112 (the mean is 22.4,
#: the deviation 4.2) give at most 92 flips.
MOST_BITS = 92

#: The same for a finer sketch, made only for members of buckets that fall into several components: 271 places of 1024
#: (mean 204.8, deviation 12.8).
FINE_SAMPLE, FINE_BITS, FINE_MOST = 1024, 4096, 491

_seeds = mix(np.arange(1, 2 * FINE_SAMPLE + 1, dtype=np.uint64))
_times = (_seeds[:FINE_SAMPLE] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_plus = (_seeds[FINE_SAMPLE:] >> np.uint64(32)).astype(np.uint32)
_salts = mix(np.arange(5000, 5000 + FINE_SAMPLE, dtype=np.uint64))

FEATURES = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>"


def minima(shingles: np.ndarray, size: int = SAMPLE) -> np.ndarray:
    """The MinHash sample of one set of shingle hashes; zeros for an empty set."""
    if not len(shingles):
        return np.zeros(size, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, 131072 // size)
    for lo in range(0, len(x), step):
        np.minimum(best, (_times[:size, None] * x[None, lo : lo + step] + _plus[:size, None]).min(axis=1), out=best)
    return best


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """One parity bitmap, as 64-bit words, for each row of minima."""
    n = len(samples)
    bit = (mix(samples.astype(np.uint64) + _salts[: samples.shape[1]]) >> np.uint64(40)).astype(np.int64) % bits
    flips = np.bincount((bit + np.arange(n)[:, None] * bits).reshape(-1), minlength=n * bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(n, bits // 64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    parts = (samples.astype(np.uint64) * (_salts[:SAMPLE] | np.uint64(1))).reshape(len(samples), BANDS, ROWS)
    return mix(mix(parts).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit numbers for each set."""
    return np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets])


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hash of the text, set size, 128-bit digest of the set, odd sketch and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(2)):
                sets = shingle_sets(data, offsets, k)
                samples = np.stack([minima(s) for s in sets])
                digests = set_digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), list_array(odd_sketches(samples)), list_array(band_keys(samples))],
                    ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sketch", "bands"],
                )

    return rows_of(docs).mapInArrow(run, FEATURES)


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): the first two name a row, up to rows that are equal in both id and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))


def full_sets(docs: DataFrame, ids: DataFrame, k: int, fine: bool = False) -> DataFrame:
    """(node, shingles array<long>, fine) of the rows that ids, (node, doc_id, text_hash, d1), name: the sorted shingle hashes, the fine sketch or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                own = pa.array(set_digests(sets)[:, 0] == batch.column(2).slice(lo, hi - lo).to_numpy())
                maps = list_array(odd_sketches(np.stack([minima(s, FINE_SAMPLE) for s in sets]), FINE_BITS)) if fine else pa.nulls(hi - lo, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), maps], ["node", "shingles", "fine"]).filter(own)

    chosen = rows_of(docs).join(ids, ["doc_id", "text_hash"]).select("node", "text", "d1")
    return chosen.mapInArrow(run, "node long, shingles array<long>, fine array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets, which are compared inside the join."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("p"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("q"))
    sizes = 100 * F.least(F.size("p"), F.size("q")) >= percent * F.greatest(F.size("p"), F.size("q"))
    shared = F.size(F.array_intersect("p", "q"))
    return pairs.join(x, "a").join(y, "b").where(sizes).where((100 + percent) * shared >= percent * (F.size("p") + F.size("q"))).select("a", "b")


def _apart(x: str, y: str, bits: int = SKETCH_BITS) -> str:
    return " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(bits // 64))


def _near(x: str, y: str, percent: int) -> F.Column:
    """Whether sizes and bitmaps of the sides x and y allow a link."""
    sizes = f"100 * least({x}_n, {y}_n) >= {percent} * greatest({x}_n, {y}_n)"
    return F.expr(f"{sizes} AND {_apart(f'{x}_sketch', f'{y}_sketch')} <= {MOST_BITS}")


def placed_rows(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row, (doc_id, text_hash, n_shingles, d1, d2), and every class of rows with equal sets, (d1, d2, doc_id, text_hash, component).

    A class has the doc_id and text_hash of its first row, component is a number; rows without words or doc_id have no class.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent is {percent}; under {LEAST_PERCENT} the bands and sketches would lose links")
    found = cut(features(docs, k))
    classes = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = cut(classes.select("d1", "d2", "first.doc_id", "first.text_hash"))
    # Nodes are numbered in the order of ids: what others were copied from often comes first, and makes the best centre.
    in_order = classes.repartitionByRange(partitions(docs.sparkSession), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    classes = cut(in_order.select("*", F.monotonically_increasing_id().alias("node")))
    reps = found.join(classes, ["d1", "d2", "doc_id", "text_hash"]).dropDuplicates(["node"])
    reps = cut(reps.select("node", "doc_id", "text_hash", "d1", F.col("n_shingles").alias("n"), "sketch", "bands"))
    light = reps.select("node", "n", "sketch", "bands")
    named = reps.select("node", "doc_id", "text_hash", "d1")

    # Buckets with more than one member; the centre is the smallest member.
    members = reps.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = cut(members.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1"))
    # Both sides of a merge join come straight from their exchanges, so that Spark can split a bucket that holds a large part of all rows.
    members = cut(members.join(buckets.hint("merge"), "key"))

    def side(name: str) -> DataFrame:
        return light.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_near("a", "b", percent)).select("a", "b")

    tried = cut(near(members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))))
    ids = cut(named.join(tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct(), "node", "left_semi"))
    sets = cut(full_sets(docs, small(ids), k).dropDuplicates(["node"]))
    links = cut(confirmed(tried, sets, percent))
    labels = components(links)

    # What a single centre cannot show: members of a bucket that are not in the component of its centre may have a link
    # to another member. They are compared with the members of other components; pairs with the centre are known.
    placed = members.where("size > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(labels.select(F.col("node").alias("centre"), F.col("component").alias("hub")), "centre", "left").withColumn("hub", F.coalesce("hub", "centre"))
    mixed = cut(placed.groupBy("key").agg(F.count_if(F.col("component") != F.col("hub")).alias("others")).where("others > 0").select("key"))
    placed = cut(placed.join(small(mixed), "key").join(light, "node").select("key", "band", "node", "centre", "component", "hub", "n", "sketch", "bands"))
    ids = cut(named.join(placed.select("node").distinct(), "node", "left_semi"))
    sets = cut(full_sets(docs, small(ids), k, fine=True).dropDuplicates(["node"]))
    placed = cut(placed.join(sets.select("node", "fine"), "node"))
    x = placed.where("component <> hub").select("key", F.col("node").alias("a"), F.col("component").alias("a_c"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"), F.col("fine").alias("a_fine"), F.col("bands").alias("a_bands"), "band")
    y = placed.where("node <> centre").select("key", F.col("node").alias("b"), F.col("component").alias("b_c"), "hub", F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"), F.col("fine").alias("b_fine"), F.col("bands").alias("b_bands"))
    # A pair is compared in the first band that it shares, and only there.
    first = "CASE " + " ".join(f"WHEN a_bands[{i}] = b_bands[{i}] THEN {i}" for i in range(BANDS)) + " END"
    apart = f"{_apart('a_fine', 'b_fine', FINE_BITS)} <= {FINE_MOST}"
    rest = x.join(y, "key").where("a_c <> b_c AND (b_c = hub OR a < b)").where(_near("a", "b", percent)).where(f"{first} = band AND {apart}")
    rest = cut(rest.select("a", "b").distinct())
    if not rest.isEmpty():
        links = cut(links.union(confirmed(rest, sets, percent)))
        labels = components(links)
    classes = classes.join(labels, "node", "left").select("d1", "d2", "doc_id", "text_hash", F.coalesce("component", "node").alias("component"))
    return found.select("doc_id", "text_hash", "n_shingles", "d1", "d2"), cut(classes)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that can be reached, itself included), kept: a row for each of docs.

    The bands and the bounds of the sketches are made for a similarity of 0.8, so a lower percent is refused.
    """
    rows, classes = placed_rows(docs, k, percent)
    names = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = classes.select("d1", "d2", "component").join(names, "component").drop("component")
    has_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    named = rows.join(classes, ["d1", "d2"], "left")
    component = F.when(has_class, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest doc_id; columns as they come.

    Rows that share a doc_id are documents of their own: where several of a component have its smallest doc_id, one is kept
    (the least hash of its text), and texts of the same id in other components stay. Of rows with equal doc_id and text one
    is kept. Documents without a doc_id are kept, since nothing can be said of them.
    """
    rows, classes = placed_rows(docs.where("doc_id IS NOT NULL"), k, percent)
    firsts = classes.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = classes.select("d1", "d2", "component").join(firsts, "component").select("d1", "d2", "first")
    # Rows with their own hash of the text, since equal sets may come from texts that differ in case or white space.
    others = rows.where("n_shingles > 0").join(classes, ["d1", "d2"]).where(F.struct("doc_id", "text_hash") != F.col("first"))
    gone = cut(others.select("doc_id", "text_hash").distinct())
    left = docs.join(small(gone), same_row(docs, gone), "left_anti")
    twice = cut(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash"))
    n = twice.count()
    if not n:
        return left
    repeated = left.join(small(twice, n), same_row(left, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(small(twice, n), same_row(left, twice), "left_anti").union(repeated)


def same_row(docs: DataFrame, named: DataFrame) -> Column:
    return (docs["doc_id"].cast("long") == named["doc_id"]) & (F.xxhash64(docs["text"]) == named["text_hash"])
