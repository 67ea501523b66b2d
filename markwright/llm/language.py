"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the runs of three and of four bytes of its lower-cased form, in which everything but letters is
one space. Each is hashed into a table of embeddings; their mean goes through a linear layer and a softmax. The model is
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents, each by its whole text: the
counts of its places in the table, of which there are as many as the table has at most. Since both layers are linear,
prediction adds up one small row for each subword of the whole text. A temperature, fit on a part of the sample kept
aside and judged as predictions are, calibrates the probabilities, and the rejection threshold is the least score from
which on that part's predictions are right in 99 of 100 cases.

Languages are learned only from rows whose held_out is false; language, source and id are never inputs.

Defined cases: a null text or one without a letter (Unicode category L) gets `und` and score 0; with no label at all every text does; null
labels are not learned; rows that repeat a doc_id are judged each by its text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import held_out, stratified
from markwright.llm.vectors import text_pieces

#: Labelled documents in the sample, size of the hash table and of an embedding.
BOUND, TABLE, DIM = 2000, 1 << 15, 16
RIGHT = 0.99
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all subwords of the texts, and how many belong to each text; a text has as many as bytes, twice."""
    # Every text is followed by three spaces, so that no subword reaches into the next one.
    n = len(offsets) - 1
    room = np.full(len(data) + 3 * n + 3, 32, dtype=np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(data)) + 3 * row
    room[at] = _FOLD[data]
    three = room[:-3] * np.uint32(0x9E3779B1) ^ room[1:-2] * np.uint32(0x85EBCA77) ^ room[2:-1] * np.uint32(0xC2B2AE3D)
    four = three * np.uint32(0x27D4EB2F) ^ room[3:] * np.uint32(0x165667B1)
    blank = (room[:-3] == 32) & (room[1:-2] == 32)
    out = np.stack([(three * np.uint32(0x2C1B3C6D)) >> np.uint32(17), (four * np.uint32(0x297A2D39)) >> np.uint32(17)], axis=1).astype(np.int32)
    keep = np.zeros(len(three), dtype=bool)
    keep[at] = True
    keep &= ~blank
    per_text = np.bincount(row[keep[at]], minlength=n)
    return out[keep], per_text


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, places, counts): the distinct table places of all subwords of each text, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(0)):
                places, count = subwords(data, offsets)
                ends = np.cumsum(count)
                found = [np.unique(places[end - m : end], return_counts=True) for m, end in zip(count, ends, strict=True)]
                lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists], ["doc_id", "lang", "places", "counts"])

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), "lang").mapInArrow(run, "doc_id long, lang string, places array<int>, counts array<int>")


def means(rows: np.ndarray, places: np.ndarray, shares: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text, whose places begin at starts, the mean of the rows of its subwords."""
    return np.stack([np.add.reduceat(rows[:, c][places] * shares, starts) for c in range(rows.shape[1])], axis=1)


def train(places: np.ndarray, shares: np.ndarray, ends: np.ndarray, label: np.ndarray, n_labels: int, seed: int = 11, steps: int = 300, batch: int = 64, rate: float = 0.4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The embeddings, the linear layer and its bias. The text that ends at ends[i] has label[i]; shares are the parts of its subwords."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (TABLE, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, n_labels)).astype(np.float32)
    bias = np.zeros(n_labels, dtype=np.float32)
    passes = max(6, -(-steps * batch // len(label)))
    sizes = np.diff(ends, prepend=0)
    for turn in range(passes):
        order = rng.permutation(len(label))
        step = rate * (1 - turn / passes)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            at = np.concatenate([np.arange(ends[r] - sizes[r], ends[r]) for r in rows])
            p_, s_ = places[at], shares[at]
            x = means(embed, p_, s_, np.cumsum(sizes[rows]) - sizes[rows])
            logits = x @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            pull = p @ out.T
            out -= 10 * step * (x.T @ p)
            bias -= step * p.sum(axis=0)
            weight = s_ * np.float32(64 * step)
            for d in range(DIM):
                embed[:, d] -= np.bincount(p_, np.repeat(pull[:, d], sizes[rows]) * weight, TABLE).astype(np.float32)
    return embed, out, bias


def fit(docs: DataFrame, bound: int = BOUND) -> dict | None:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = counted(stratified(known, "lang", bound)).where("size(places) > 0").orderBy("doc_id", "lang", "places", "counts").toArrow()
    if not found.num_rows:
        return None
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    label = np.array([langs.index(v) for v in names])
    lists = found.column("places").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    places, counts = lists.flatten().to_numpy(), found.column("counts").combine_chunks().flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    shares = (counts / np.repeat(np.add.reduceat(counts, starts), sizes)).astype(np.float32)
    aside = np.arange(len(label)) % 5 == 4
    aside &= np.isin(label, label[~aside])  # a language is not set aside whole
    inside = np.repeat(~aside, sizes)
    embed, out, bias = train(places[inside], shares[inside], np.cumsum(sizes[~aside]), label[~aside], len(langs))
    # The product of the two layers, where it is the smaller table.
    rows, head = (embed @ out, np.eye(len(langs), dtype=np.float32)) if len(langs) <= DIM else (embed, out)
    temperature, threshold = 1.0, 0.0
    if aside.any():
        far = ~inside
        logits = means(rows.astype(np.float64), places[far], shares[far], np.cumsum(sizes[aside]) - sizes[aside]) @ head + bias
        best = {}
        for t in np.geomspace(0.05, 20, 60):
            z = logits / t
            z -= z.max(axis=1, keepdims=True)
            best[float(t)] = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), label[aside]]).mean())
        temperature = min(best, key=best.get)
        p = _softmax(logits / temperature)
        right, top = p.argmax(axis=1) == label[aside], p.max(axis=1)
        order = np.argsort(-top, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= RIGHT * np.arange(1, len(order) + 1))
        threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return {"langs": langs, "rows": rows.astype(np.float32), "head": head, "bias": bias, "temperature": temperature, "threshold": threshold}


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (the score is under the calibrated threshold) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE rows of DIM numbers at most, and DIM for each of the languages, which the sample bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_pieces(batch.column(2)):
                lettered = batch.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                lang, score, low = ["und"] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, dtype=bool)
                if m is not None:
                    places, count = subwords(data, offsets)
                    ends = np.cumsum(count)
                    total = np.stack([np.concatenate([[0], np.cumsum(m["rows"][:, c][places].sum(axis=1, dtype=np.float64))]) for c in range(m["rows"].shape[1])], axis=1)
                    logits = (total[ends] - total[ends - count]) / np.maximum(2 * count, 1)[:, None] @ m["head"] + m["bias"]
                    p = _softmax(logits / m["temperature"])
                    lang = [m["langs"][i] if ok else "und" for i, ok in zip(p.argmax(axis=1), lettered, strict=True)]
                    score = np.where(lettered, p.max(axis=1), 0.0)
                    low = score < m["threshold"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score), pa.array(low)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
