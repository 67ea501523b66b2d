"""Removal of byte strings of 50 or more that an earlier document holds, by longest-previous-factor arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. In suffix order, the
longest factor at a position that occurs in a smaller document is the longer of its common prefixes with the previous and
the next suffix of a smaller document; where that length is 50 or more, so many bytes from the position on are covered.
No task could hold the suffixes of a whole corpus, so they are dealt out; hashes deal the work, and bytes decide.

1. Every 50-byte window has an anchor: the 24-byte gram in it with the least hash, the leftmost of equal ones. Equal
   windows have equal anchors. The windows of one anchor form a context, 50 to 76 bytes long. Anchor hashes with their
   documents are dealt by hash, and each document hears which of its anchors another document has too.
2. Texts and answers meet by blocks of documents. A task takes the contexts of shared anchors, sorts equal ones as
   suffixes and drops those that are covered whole by their factor in a smaller document of the task. The others are
   dealt by anchor, as bytes; the windows of an anchor that very many documents share are dealt one by one instead.
3. What shares an anchor is put in suffix order, contexts first and then the windows of those left, and the
   longest-previous-factor lengths give the covered runs, which go back to the blocks, where the texts are cut.

A block is what goes to one shuffle partition, by a mix of the bits of doc_id; its texts pass as a stream. Rows that repeat
a doc_id stand in one block in order of the hashes of their texts, and are told apart by their place in it.

Defined cases: a null text is an empty one; texts under 50 bytes stay as they are; rows that repeat a doc_id don't
cover each other, and each is judged by itself; rows without a doc_id stay as they are and cover nothing; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import cut, partitions
from markwright.llm.vectors import PIECE, mix, powers, prefix_hash, text_pieces

WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1
#: Bytes of the longest context, in whole words, and of what is compared of a window.
WIDE, NEAR = 80, 56
#: Bytes of text, documents and contexts after which a task passes on what it has.
FLUSH, ROWS, CONTEXTS = 24 << 20, 60_000, 200_000
#: An anchor in more documents than COMMON, and than COMMON_OF_BLOCK for each block, has its windows dealt one by one.
COMMON, COMMON_OF_BLOCK = 20_000, 4
_PLACE = np.uint64((1 << 24) - 1)
_CODEC = "zstd"

SHAPE = "bucket int, block int, kind int, n long, doc binary, row binary, place binary, size binary, off binary, data binary"
_SHAPE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("doc", "row", "place", "size", "off", "data"))])
#: kind, as dealt and as answered: anchors to compare; shared anchors of documents; very common anchors; contexts; covered runs; texts.
ANCHORS, SHARED, HOT, PIECES, RUNS, TEXT = range(6)


def pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: planes of like bytes cost next to nothing."""
    planes = np.ascontiguousarray(x.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec=_CODEC, asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_SHAPE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SHAPE.types, strict=True)], schema=_SHAPE)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal keys."""
    at = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, dtype=np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = np.append(False, same) | np.append(same, False) if len(keys) else False
    return out


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a document; _block is the same as a column."""
    u = doc.astype(np.int64).view(np.uint64)
    return ((u ^ (u >> np.uint64(17)) ^ (u >> np.uint64(37))).view(np.int64) % blocks).astype(np.int64)


def _block(doc: str, blocks: int) -> Column:
    return F.expr(f"CAST(pmod({doc} ^ shiftrightunsigned({doc}, 17) ^ shiftrightunsigned({doc}, 37), {blocks}) AS INT)")


def pair_keys(anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """40 bits for an anchor of a document."""
    return (mix(anchor ^ mix(doc.astype(np.int64).view(np.uint64))) >> np.uint64(24)).view(np.int64)


def cut_texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, (row, place in its text) of each part) in pieces; long texts in parts that overlap by a window less one."""
    if len(data) <= 2 * PIECE:
        rows = np.arange(len(offsets) - 1)
        yield data, offsets, np.stack([rows, np.zeros_like(rows)], axis=1)
        return
    for row in range(len(offsets) - 1):
        text = data[offsets[row] : offsets[row + 1]]
        for at in range(0, max(len(text) - WINDOW + 1, 1), PIECE):
            part = text[at : at + PIECE + WINDOW - 1]
            yield part, np.array([0, len(part)]), np.array([[row, at]])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Part, first window, last window, place of the anchor and 48-bit anchor hash of every context in the parts."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return none, none, none, none, none.astype(np.uint64)
    sums = prefix_hash(data)
    _, down = powers(n + 1)
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[SPAN - width : SPAN - width + n - WINDOW + 1])
    sizes = np.diff(offsets)
    edge = np.zeros(n + 1, dtype=np.int32)
    good = sizes >= WINDOW
    np.add.at(edge, offsets[:-1][good], 1)
    np.add.at(edge, offsets[1:][good] - WINDOW + 1, -1)
    valid = np.cumsum(edge)[: n - WINDOW + 1] > 0
    window = np.flatnonzero(valid)
    if not len(window):
        return none, none, none, none, none.astype(np.uint64)
    at = (least[window] & _PLACE).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    start = np.flatnonzero(new)
    first, last, spot = window[start], window[np.append(start[1:], len(window)) - 1], at[start]
    part = np.searchsorted(offsets, first, side="right") - 1
    return part, first, last, spot, mix(grams[spot]) >> np.uint64(16)


def common_prefixes(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each row of big-endian words shares with the row before it, within both sizes; 0 for the first."""
    if len(words) < 2:
        return np.zeros(len(words), dtype=np.int64)
    apart = words[1:] ^ words[:-1]
    where = (apart != 0).argmax(axis=1)
    first = apart[np.arange(len(apart)), where]
    bytes_ = sum((first < np.uint64(1) << np.uint64(8 * i)).astype(np.int64) for i in range(1, 8))
    shared = np.where(first == 0, 8 * words.shape[1], 8 * where + bytes_)
    return np.append(0, np.minimum(shared, np.minimum(sizes[1:], sizes[:-1])))


def to_smaller(doc: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For suffixes in order, the common prefix with the nearest one before of a smaller document; only lengths from WINDOW on count.

    Pointers that have not met a smaller document take the pointer of the place they stand on, so a round doubles their reach.
    """
    back, length = np.arange(-1, len(doc) - 1), prefix.copy()
    todo = np.flatnonzero(length >= WINDOW)
    todo = todo[doc[back[todo]] >= doc[todo]]
    while len(todo):
        on = back[todo]
        length[todo], back[todo] = np.minimum(length[todo], length[on]), back[on]
        length[todo[back[todo] < 0]] = 0
        todo = todo[length[todo] >= WINDOW]
        todo = todo[doc[back[todo]] >= doc[todo]]
    return length


def previous_factors(words: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The longest-previous-factor length of each suffix, given as rows of words; lengths under WINDOW count as none."""
    order = np.lexsort([doc, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1))])
    prefix = common_prefixes(words[order], sizes[order])
    ordered = doc[order]
    before = to_smaller(ordered, prefix)
    after = to_smaller(ordered[::-1], np.append(0, prefix[:0:-1]))[::-1]
    out = np.zeros(len(doc), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


def taken_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` bytes from each place, zero after its size."""
    padded = np.append(data, np.zeros(width, dtype=np.uint8))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    return np.where(np.arange(width) < sizes[:, None], rows, 0).astype(np.uint8)


def as_words(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def word_hash(words: np.ndarray) -> np.ndarray:
    key = np.zeros(len(words), dtype=np.uint64)
    for i, w in enumerate(words.T):
        key = mix(key + w + np.uint64(i + 1))
    return key


def covered_whole(rows: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which contexts are covered whole by their factor in a smaller document among these."""
    words = as_words(rows)
    alike = np.flatnonzero(_repeated(word_hash(words) + sizes.astype(np.uint64)))  # others can't be
    out = np.zeros(len(sizes), dtype=bool)
    if len(alike):
        out[alike] = previous_factors(words[alike], sizes[alike], doc[alike]) == sizes[alike]
    return out


def covered_runs(rows: np.ndarray, sizes: np.ndarray, off: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end): the runs that the factors of the windows of these contexts cover."""
    none = np.zeros(0, dtype=np.int64)
    gram = word_hash(as_words(taken_bytes(rows.reshape(-1), np.arange(len(rows)) * WIDE + off, np.full(len(rows), GRAM), GRAM)))
    order = np.argsort(gram, kind="stable")
    at = np.array([a for a, _ in _runs(gram[order])] + [len(rows)])
    if len(rows) < 2:
        return none, none, none
    many = np.minimum.reduceat(doc[order], at[:-1]) < np.maximum.reduceat(doc[order], at[:-1])
    chosen = order[np.repeat(many, np.diff(at))]
    windows = sizes[chosen] - WINDOW + 1
    of = np.repeat(chosen, windows)
    start = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(of):
        return none, none, none
    flat = rows.reshape(-1)
    alike = np.flatnonzero(_repeated(word_hash(as_words(taken_bytes(flat, of * WIDE + start, np.full(len(of), WINDOW), NEAR)))))
    of, start = of[alike], start[alike]
    left = np.minimum(sizes[of] - start, NEAR)
    factor = previous_factors(as_words(taken_bytes(flat, of * WIDE + start, left, NEAR)), left, doc[of]) if len(of) else none
    of, start, end = of[factor >= WINDOW], start[factor >= WINDOW], (start + factor)[factor >= WINDOW]
    order = np.lexsort([start, of])
    return join_runs(of[order], start[order], end[order])


def join_runs(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of owner and start, made maximal."""
    if not len(of):
        return of, start, end
    # The greatest end so far within an owner: owners are lifted over each other.
    rank = np.append(0, np.cumsum(of[1:] != of[:-1]))
    lift = rank * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    first = np.flatnonzero(np.append(True, (start + lift)[1:] > reach[:-1]))
    return of[first], start[first], np.append(reach[first[1:] - 1], reach[-1]) - lift[first]


def deal_anchors(docs: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """Anchors of all documents by bucket; what documents of one task share is dealt once, with their number, and answered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            doc = np.concatenate(ids)
            packed = np.unique(np.concatenate(held))
            anchor, owner = packed >> np.uint64(16), doc[(packed & np.uint64(0xFFFF)).astype(np.int64)]
            at = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
            low = np.minimum.reduceat(owner, at[:-1])
            many = low < np.maximum.reduceat(owner, at[:-1])
            shared = np.repeat(many, np.diff(at))
            out = answers(anchor[shared], owner[shared], buckets, blocks)
            anchor, count = anchor[at[:-1]], np.where(many, np.diff(at), 1)
            bucket = ((anchor >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            for a, b in _runs(bucket):
                out.append((int(bucket[a]), None, ANCHORS, b - a, pack(low[a:b]), None, pack(np.diff(anchor[a:b].view(np.int64), prepend=0)), pack(count[a:b]), None, None))
            return _batch(out)

        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                for a in range(lo, hi, ROWS):
                    b = min(a + ROWS, hi)
                    if rows + b - a > ROWS:
                        yield flush() if held else _batch([])
                        ids, held, rows, size = [], [], 0, 0
                    ids.append(own[a:b])
                    inner = offsets[a - lo : b - lo + 1]
                    for part, ends, origin in cut_texts(data[inner[0] : inner[-1]], inner - inner[0]):
                        row, _, _, _, anchor = anchors(part, ends)
                        if len(row):
                            held.append(anchor << np.uint64(16) | (origin[row, 0] + rows).astype(np.uint64))
                    rows += b - a
                size += len(data)
                if size >= FLUSH:
                    yield flush() if held else _batch([])
                    ids, held, rows, size = [], [], 0, 0
        if held:
            yield flush()

    return docs.mapInArrow(run, SHAPE)


def answers(anchor: np.ndarray, doc: np.ndarray, buckets: int, blocks: int) -> list[tuple]:
    """A row for each block with the keys of its documents' shared anchors."""
    block = block_of(doc, blocks)
    key = pair_keys(anchor, doc)
    order = np.lexsort([key, block])
    block, key = block[order], key[order]
    return [(int(block[a]) % buckets, int(block[a]), SHARED, b - a, None, None, pack(np.diff(key[a:b], prepend=0)), None, None, None) for a, b in _runs(block)]


def compare_anchors(dealt: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """Answers for each block, from all anchors of each bucket."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        out = [group.filter(pa.array(kind != ANCHORS)).cast(_SHAPE)]
        rows = group.filter(pa.array(kind == ANCHORS)).select(["n", "doc", "place", "size"]).to_pylist()
        if rows:
            anchor = np.concatenate([np.cumsum(unpack(r["place"], r["n"])) for r in rows]).view(np.uint64)
            doc, count = (np.concatenate([unpack(r[c], r["n"]) for r in rows]) for c in ("doc", "size"))
            order = np.argsort(anchor, kind="stable")
            anchor, doc, count = anchor[order], doc[order], count[order]
            at = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
            total = np.add.reduceat(count, at[:-1])
            many = (np.minimum.reduceat(doc, at[:-1]) < np.maximum.reduceat(doc, at[:-1])) | (np.maximum.reduceat(count, at[:-1]) > 1)
            told = np.repeat(many, np.diff(at)) & (count == 1)
            found = answers(anchor[told], doc[told], buckets, blocks)
            hot = anchor[at[:-1]][many & (total > max(COMMON, COMMON_OF_BLOCK * blocks))]
            if len(hot):
                found += [(b % buckets, b, HOT, len(hot), None, None, pack(hot), None, None, None) for b in range(blocks)]
            out.append(pa.Table.from_batches([_batch(found)]))
        return pa.concat_tables(out)

    return dealt.groupBy("bucket").applyInArrow(run, SHAPE)


def beside_texts(texts: DataFrame, told: DataFrame, blocks: int) -> DataFrame:
    """What blocks were told and then their texts, in order within each block."""
    first = told.select("block", "kind", "n", "doc", "row", "place", "size", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("binary").alias("text"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("doc", "row", "place", "size")]
    then = texts.select("block", F.lit(TEXT).alias("kind"), F.lit(None).cast("long").alias("n"), *none, "doc_id", "hash", "text")
    return first.union(then).repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "doc_id", "hash")


class Marks:
    """Numbers rows that repeat a doc_id, as they come in order of doc_id and hash: the same in each pass."""

    def __init__(self) -> None:
        self.last: tuple[int | None, int] = (None, -1)

    def of(self, ids: pa.Array) -> np.ndarray:
        there = ids.is_valid().to_numpy(zero_copy_only=False)
        out, own = np.zeros(len(ids), dtype=np.int64), ids.drop_null().to_numpy(zero_copy_only=False)
        if len(own):
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            marks = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
            if self.last[0] == own[0]:
                marks[: at[1] if len(at) > 1 else len(own)] += self.last[1] + 1
            self.last = (int(own[-1]), int(marks[-1]))
            out[there] = marks
        return out


def in_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """(block, rows, are they texts) of runs of a batch."""
    block, text = batch.column(0).to_numpy(), batch.column(1).to_numpy() == TEXT
    for a, b in _runs(2 * block.astype(np.int64) + text):
        yield int(block[a]), batch.slice(a, b - a), bool(text[a])


def deal_pieces(beside: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """The contexts that share an anchor, as bytes by bucket, and the runs that a smaller document of the task covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count, now = 0, -1
        told: dict[int, list[np.ndarray]] = {SHARED: [], HOT: []}
        keys: dict[int, np.ndarray] | None = None
        numbered = Marks()

        def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
            if not len(listed):
                return np.zeros(len(values), dtype=bool)
            return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values

        def contexts(ids: np.ndarray, marks: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
            nonlocal count
            for part, ends, origin in cut_texts(data, offsets):
                row, first, last, spot, anchor = anchors(part, ends)
                mine = among(pair_keys(anchor, ids[origin[row, 0]]), keys[SHARED])
                if not mine.any():
                    continue
                row, first, last, spot, anchor = (x[mine] for x in (row, first, last, spot, anchor))
                common = among(anchor, keys[HOT].view(np.uint64))
                if common.any():  # a context for each window, dealt by its own bytes
                    n = np.where(common, last - first + 1, 1)
                    of = np.repeat(np.arange(len(row)), n)
                    shift = np.where(common[of], np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), 0)
                    row, spot, anchor, common = row[of], spot[of], anchor[of], common[of]
                    first = first[of] + shift
                    last = np.where(common, first, last[of])
                size = last - first + WINDOW
                rows = taken_bytes(part, first, size, WIDE)
                if common.any():
                    anchor = np.where(common, word_hash(as_words(rows)) >> np.uint64(16), anchor)
                line = origin[row, 0]
                held.append((ids[line], marks[line], first - ends[row] + origin[row, 1], size, spot - first, anchor, rows))
                count += len(row)

        def flush() -> pa.RecordBatch:
            doc, mark, place, size, off, anchor, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            whole = covered_whole(rows, size, doc)
            out = run_rows(doc[whole], mark[whole], place[whole], (place + size)[whole], buckets, blocks)
            doc, mark, place, size, off, anchor, rows = (x[~whole] for x in (doc, mark, place, size, off, anchor, rows))
            bucket = ((anchor >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort([anchor, bucket])
            for a, b in _runs(bucket[order]):
                i = order[a:b]
                data = rows[i][np.arange(WIDE) < size[i][:, None]].tobytes()
                out.append((int(bucket[i[0]]), None, PIECES, b - a, pack(doc[i]), pack(mark[i]), pack(place[i]), pack(size[i]), pack(off[i]), pa.compress(data, codec=_CODEC, asbytes=True)))
            return _batch(out)

        for batch in batches:
            for block, rows, is_text in in_blocks(batch):
                if block != now:
                    now, keys, told = block, None, {SHARED: [], HOT: []}
                if not is_text:
                    for kind, n, place in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(5).to_pylist(), strict=True):
                        values = unpack(place, n)
                        told[kind].append(np.cumsum(values) if kind == SHARED else values)
                    continue
                if keys is None:
                    keys = {k: np.unique(np.concatenate(v)) if v else np.zeros(0, dtype=np.int64) for k, v in told.items()}
                    told = {}
                marks = numbered.of(rows.column(7))
                if not len(keys[SHARED]):
                    continue
                ids = rows.column(7).to_numpy()
                for lo, hi, data, offsets in text_pieces(rows.column(9)):
                    contexts(ids[lo:hi], marks[lo:hi], data, offsets)
                    if count >= CONTEXTS:
                        yield flush()
                        count = 0
        if held:
            yield flush()

    return beside.mapInArrow(run, SHAPE)


def run_rows(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int, blocks: int) -> list[tuple]:
    """A row for each block with the covered runs of its documents, made maximal."""
    if not len(doc):
        return []
    order = np.lexsort([start, mark, doc])
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    owner = np.append(0, np.cumsum((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))
    at = np.searchsorted(owner, np.arange(owner[-1] + 1))
    of, start, end = join_runs(owner, start, end)
    doc, mark = doc[at][of], mark[at][of]
    block = block_of(doc, blocks)
    order = np.argsort(block, kind="stable")
    doc, mark, start, end, block = (x[order] for x in (doc, mark, start, end, block))
    return [(int(block[a]) % buckets, int(block[a]), RUNS, b - a, pack(doc[a:b]), pack(mark[a:b]), pack(start[a:b]), pack((end - start)[a:b]), None, None) for a, b in _runs(block)]


def compare_pieces(dealt: DataFrame, buckets: int, blocks: int) -> DataFrame:
    """The covered runs for each block, from the contexts of each bucket in suffix order."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        out = [group.filter(pa.array(kind != PIECES)).cast(_SHAPE)]
        dealt_rows = group.filter(pa.array(kind == PIECES)).to_pylist()
        if dealt_rows:
            doc, mark, place, size, off = (np.concatenate([unpack(r[c], r["n"]) for r in dealt_rows]) for c in ("doc", "row", "place", "size", "off"))
            inside = np.arange(WIDE) < size[:, None]
            rows = np.zeros((len(doc), WIDE), dtype=np.uint8)
            ends = np.cumsum([0, *(r["n"] for r in dealt_rows)])
            for r, a, b in zip(dealt_rows, ends[:-1], ends[1:], strict=True):
                n = int(size[a:b].sum())
                rows[a:b][inside[a:b]] = np.frombuffer(pa.decompress(r["data"], decompressed_size=n, codec=_CODEC, asbytes=True), dtype=np.uint8)
            whole = covered_whole(rows, size, doc)
            left = np.flatnonzero(~whole)
            of, start, end = covered_runs(rows[left], size[left], off[left], doc[left])
            of = left[of]
            all_of = np.concatenate([np.flatnonzero(whole), of])
            starts = place[all_of] + np.concatenate([np.zeros(int(whole.sum()), dtype=np.int64), start])
            ends = place[all_of] + np.concatenate([size[whole], end])
            out.append(pa.Table.from_batches([_batch(run_rows(doc[all_of], mark[all_of], starts, ends, buckets, blocks))]))
        return pa.concat_tables(out)

    return dealt.groupBy("bucket").applyInArrow(run, SHAPE)


def finish(beside: DataFrame) -> DataFrame:
    """doc_id, kept bytes and the removed runs as (start, end) pairs of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, numbered = -1, [], Marks()
        doc = mark = start = end = np.zeros(0, dtype=np.int64)
        fresh = False

        def batch_of(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for block, rows, is_text in in_blocks(batch):
                if block != now:
                    now, told, fresh = block, [], True
                if not is_text:
                    for n, *columns in zip(*(rows.column(i).to_pylist() for i in (2, 3, 4, 5, 6)), strict=True):
                        told.append([unpack(c, n) for c in columns])
                    continue
                if fresh:
                    doc, mark, start, end = (np.concatenate(x) for x in zip(*told, strict=True)) if told else [np.zeros(0, dtype=np.int64)] * 4
                    order = np.lexsort([start, mark, doc])
                    doc, mark, start, end = doc[order], mark[order], start[order], (start + end)[order]
                    told, fresh = [], False
                out: list[list] = [[], [], [], [], []]
                held = 0
                for doc_id, row, text in zip(rows.column(7).to_pylist(), numbered.of(rows.column(7)).tolist(), rows.column(9), strict=True):
                    raw = text.as_buffer()
                    starts, ends = [], []
                    if doc_id is not None:
                        a, b = np.searchsorted(doc, doc_id), np.searchsorted(doc, doc_id, side="right")
                        a, b = a + np.searchsorted(mark[a:b], row), a + np.searchsorted(mark[a:b], row, side="right")
                        if b > a:
                            _, x, y = join_runs(np.zeros(b - a, dtype=np.int64), start[a:b], end[a:b])
                            starts, ends = x.tolist(), y.tolist()
                    kept = b"".join(memoryview(raw)[i:j] for i, j in zip([0, *ends], [*starts, len(raw)], strict=True)) if starts else raw.to_pybytes()
                    for column, value in zip(out, (doc_id, len(raw), kept, starts, ends), strict=True):
                        column.append(value)
                    held += len(kept)
                    if held > 4 * PIECE:
                        yield batch_of(out)
                        out, held = [[], [], [], [], []], 0
                yield batch_of(out)

    return beside.mapInArrow(run, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), starts and ends of the removed runs, for every document."""
    spark = docs.sparkSession
    blocks, buckets = partitions(spark), 2 * partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = texts.withColumn("block", F.coalesce(_block("doc_id", blocks), F.pmod("hash", F.lit(blocks)).cast("int")))
    known = texts.where("doc_id IS NOT NULL")
    shared = cut(compare_anchors(deal_anchors(known.select("doc_id", "text"), buckets, blocks), buckets, blocks))
    pieces = deal_pieces(beside_texts(known, shared, blocks), buckets, blocks)
    return finish(beside_texts(texts, cut(compare_pieces(pieces, buckets, blocks)), blocks))


def digests(removed: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept").cast("long")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
