"""Quality classifier by Bradley-Terry pairwise ranking.

Each text is described by a few shares of its bytes and words, and by how often its words fall into each of WORDS hash
buckets. A document's score is a weighted sum of these features;
the weights come from preference pairs (a document of quality 1 against one of quality 0) by logistic loss on the
difference of their features, as in the Bradley-Terry model. The threshold is a quantile of the scores: as many of the
labelled documents fall below it as have quality 0. A logistic curve around the threshold turns a score into a
number from 0 to 1, 0.5 at the threshold.

Labels are learned only from rows whose held_out is false; language, source and id are never inputs. Means, scales,
weights and threshold come from every labelled document, each whole, and from all pairs of them; every document is scored
whole. The pairs are not written out: what a document adds to the slope of the loss depends on its own features and on
how the other class's scores lie about its own, and those are counted on a grid. So a round of descent is two sums over
the labelled documents. All sums are of whole numbers, so a model does not depend on how rows are dealt.

Defined cases: null and blank texts are described by zeros and scored as any other; with labels of one kind or none the
score is 0.5 for all and predicted is 1; null labels and labels without a document are left out, those that repeat a
doc_id count each; extra columns are ignored; rows that repeat a doc_id are learned from and scored each by its text; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import BROADCAST_ROWS, cut, held_out, stratified
from markwright.llm.vectors import prefix_hash, LOWER, sub_hash, text_pieces, word_bounds

#: Rounds of descent, and how strongly weights are drawn to zero.
ROUNDS, DECAY = 12, 0.01
#: Scores on which the classes are weighed against each other; a score between two of them counts for both in proportion.
GRID = np.arange(-512, 513) / 16
#: Sums are counted in parts of one of this size.
ONE = 2.0**26
#: Equal spans of scores counted in a round of the search for the threshold.
SPANS = 4096
#: Labelled documents in a step of a task.
STEP = 2048
#: Hash buckets of words, and the weight of theirs beside the other features.
WORDS, WORD_WEIGHT = 256, 0.2

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b"!?", "symbol": b"#$%&*+/<=>@\\^_`{}~", "bar": b"|", "stop": b".,;:", "line": b"\n",
}
_TABLES = []
for chars in _CLASSES.values():
    flags = np.zeros(256, dtype=np.uint8)
    flags[list(chars)] = 1
    _TABLES.append(flags)
NAMES = [*_CLASSES, "word_length", "long_words", "distinct", "repeats", "rare", "length", "marked_words"]


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text, in the precision in which they are learned from and scored."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def per_row(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    shares = [per_row(flags[data]) / size for flags in _TABLES]
    starts, ends, row = word_bounds(data, offsets)
    words = np.bincount(row, minlength=n)
    some = np.maximum(words, 1)
    length = ends - starts
    key = sub_hash(prefix_hash(LOWER[data]), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    same_row = row[1:] == row[:-1]
    repeated = np.bincount(row[1:][same_row & (key[1:] == key[:-1])], minlength=n)
    order = np.lexsort([key, row])
    fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(key) else np.zeros(0, dtype=bool)
    distinct = np.bincount(row[order][fresh], minlength=n)
    last = data[ends - 1] if len(ends) else np.zeros(0, dtype=np.uint8)
    marked = np.bincount(row[(_TABLES[3][last] | _TABLES[2][last]) > 0], minlength=n)
    few = np.stack(
        [*shares, np.bincount(row, length, n) / some / 10, np.bincount(row[length > 20], minlength=n) / some, distinct / some, repeated / some, distinct / np.sqrt(some) / 10, np.log1p(words) / 10, marked / some], axis=1
    )
    return np.hstack([few, word_shares(key, row, n)]).astype(np.float32)


def word_shares(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The root of the share of each text's words that falls into each bucket."""
    counts = np.bincount(row * WORDS + (key >> np.uint64(56)).astype(np.int64) % WORDS, minlength=n * WORDS).reshape(n, WORDS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def scaled(x: np.ndarray, model: dict) -> np.ndarray:
    """Features about their means, by their scales, with word buckets at their weight."""
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    z[:, len(NAMES) :] *= WORD_WEIGHT
    return z


def raw(x: np.ndarray, model: dict) -> np.ndarray:
    """Scores before the logistic curve, summed row by row so that equal texts score the same in any batch."""
    return (scaled(x, model) * model["w"]).sum(axis=1)


def described(docs: DataFrame, *more: str) -> DataFrame:
    """The columns `more` and the features of each text, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(0)):
                x = describe(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[1:]] + [lists], [*more, "features"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in more), "features array<float>"])
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), *more).mapInArrow(run, schema)


def exact(values: np.ndarray) -> np.ndarray:
    """Values as whole numbers of 1 / ONE, whose sums do not depend on their order while they stay below 2**53."""
    return np.rint(values * ONE)


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of some labelled rows, and how often each of them is labelled good and bad."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            x = part.column("features").flatten().to_numpy().astype(np.float64).reshape(part.num_rows, -1)
            yield x, part.column("good").to_numpy().astype(np.float64), part.column("bad").to_numpy().astype(np.float64)


def totals(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], size: int) -> np.ndarray:
    """The sum over all labelled rows of the vectors that `of` makes of some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for x, good, bad in steps(batches):
            out += np.concatenate(of(x, good, bad))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["place", "value"])

    sums = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return out


def labelled(docs: DataFrame, labels: DataFrame, target: str, bound: int | None) -> DataFrame:
    """Features of every document with labels that may be learned from, and how many of them call it good and bad."""
    known = labels.where(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(target).cast("int").alias("label"))
    if bound is not None:
        known = stratified(known, "label", bound)
    known = cut(known.groupBy("doc_id").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    if known.count() <= BROADCAST_ROWS:
        return cut(described(texts.join(F.broadcast(known), "doc_id"), "good", "bad"))
    # Features are shorter than texts, so they are what a shuffle carries.
    return cut(described(texts, "doc_id").join(known, "doc_id").select("good", "bad", "features"))


def rank_pairs(rows: DataFrame, model: dict, n_good: float, n_bad: float) -> tuple[np.ndarray, float]:
    """Weights that put good rows over bad ones, by logistic loss over all pairs, and the spread of the scores they give.

    A round solves for the step under a bound of the loss's curvature: a quarter of the pairs' mean squared differences.
    """
    width = len(model["mean"])

    def scatter(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
        z = scaled(x, model)
        whole = np.rint(z * 2.0**12)  # products of two are summed, so these are coarser
        return [good @ exact(z), bad @ exact(z), ((good[:, None] * whole).T @ whole).ravel(), ((bad[:, None] * whole).T @ whole).ravel()]

    sums = totals(rows, scatter, 2 * width + 2 * width * width)
    mean_good, mean_bad = sums[:width] / n_good / ONE, sums[width : 2 * width] / n_bad / ONE
    square_good, square_bad = (sums[2 * width :].reshape(2, width, width) / 2**24) / np.array([n_good, n_bad])[:, None, None]
    cross = np.outer(mean_good, mean_bad)
    curve = (square_good + square_bad - cross - cross.T) / 4 + DECAY * np.eye(width)

    #: The chance that a row with the column's score is preferred to one with the line's.
    chance = 1 / (1 + np.exp(GRID[:, None] - GRID))
    w = np.linalg.solve(curve, (mean_good - mean_bad) / 2)
    for _ in range(ROUNDS - 1):
        at = model | {"w": w}

        def histogram(x: np.ndarray, good: np.ndarray, bad: np.ndarray, at: dict = at) -> list[np.ndarray]:
            place = (np.clip(raw(x, at), GRID[0], GRID[-1]) - GRID[0]) / (GRID[1] - GRID[0])
            lower = np.minimum(place.astype(np.int64), len(GRID) - 2)
            up = exact(place - lower)
            return [np.bincount(lower, n * (ONE - up), len(GRID)) + np.bincount(lower + 1, n * up, len(GRID)) for n in (good, bad)]

        over = totals(rows, histogram, 2 * len(GRID)).reshape(2, -1) / ONE
        beaten, beating = chance @ over[1] / n_bad, over[0] @ chance / n_good

        def slope(x: np.ndarray, good: np.ndarray, bad: np.ndarray, at: dict = at, beaten: np.ndarray = beaten, beating: np.ndarray = beating) -> list[np.ndarray]:
            z, s = scaled(x, at), raw(x, at)
            return [good @ exact(z * np.interp(s, GRID, beaten)[:, None]), bad @ exact(z * np.interp(s, GRID, beating)[:, None])]

        up, down = totals(rows, slope, 2 * width).reshape(2, -1) / ONE
        w = w + np.linalg.solve(curve, up / n_good - down / n_bad - DECAY * w)
    n = n_good + n_bad
    square, mean = (n_good * square_good + n_bad * square_bad) / n, (n_good * mean_good + n_bad * mean_bad) / n
    return w, float(np.sqrt(max(w @ square @ w - (w @ mean) ** 2, 0)))


def split_at(scores: DataFrame, below: int) -> tuple[float, float]:
    """The below-th smallest score and the next one, each score counted n times; exact, by ever narrower spans.

    A span has the least and largest score in it for its ends, so equal scores end the search however many they are.
    """
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    above = high
    while low < high:
        inside = scores.where(F.col("score").between(low, high))
        place = F.floor((F.col("score") - F.lit(low)) / F.lit(high - low) * SPANS)
        spans = inside.groupBy(place.alias("place")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("n").alias("n")).orderBy("place").collect()
        i = 0
        while spans[i]["n"] < below:
            below -= spans[i]["n"]
            i += 1
        above = spans[i + 1]["low"] if i + 1 < len(spans) else above
        low, high, n = spans[i]["low"], spans[i]["high"], spans[i]["n"]
    return low, low if below < n else above


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int | None = None) -> dict | None:
    """Mean and scale of the features, weights, threshold and slope; None if the labels are not of both kinds.

    With a bound, for trials, the model is that of so many labels at most, an even share of either kind; without, of all.
    """
    rows = labelled(docs, labels, target, bound)
    width = len(NAMES) + WORDS

    sums = totals(rows, lambda x, good, bad: [[good.sum(), bad.sum()], (good + bad) @ exact(x)], 2 + width)
    n_good, n_bad = sums[:2]
    if not n_good or not n_bad:
        return None
    n, mean = n_good + n_bad, sums[2:] / ONE / (n_good + n_bad)
    square = totals(rows, lambda x, good, bad: [(good + bad) @ exact((x - mean) ** 2)], width) / ONE / n
    model = {"mean": mean, "scale": np.sqrt(square) + 1e-3}
    model["w"], spread = rank_pairs(rows, model, n_good, n_bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, good, bad in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(raw(x, model)), pa.array((good + bad).astype(np.int64))], ["score", "n"])

    low, high = split_at(cut(rows.mapInArrow(run, "score double, n long")), int(n_bad))
    return model | {"threshold": (low + high) / 2, "slope": float(4 / (spread + 1e-6))}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(2)):
                if model is None:
                    s = np.full(hi - lo, 0.5)
                else:
                    s = 1 / (1 + np.exp(-np.clip((raw(describe(data, offsets), model) - model["threshold"]) * model["slope"], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents predicted good, in one pass; columns as they come."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text")).fill_null("")
            keep = []
            for _, _, data, offsets in text_pieces(text):
                keep.append(raw(describe(data, offsets), model) >= model["threshold"])
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs if model is None else docs.mapInArrow(run, docs.schema)
