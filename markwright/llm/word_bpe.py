"""BPE encoding and decoding by a distinct-word table.

Texts are split into words where the tokenizer's own splitting can't join or look across: at white space, between ASCII
letters, digits and marks, but not inside a control string of the vocabulary, behind an apostrophe (contractions), or
beside a character that is not ASCII (normalisation, classes beyond ASCII). The tokens of a text are then those of its
words, one after the other, whatever the words' neighbours are.

Runs of texts of some megabytes make a block, in which a word is stored once and texts are lists of codes, the frequent
words having the small ones. The words of all blocks are dealt by word, so that each distinct word is encoded by the
tokenizers library once, in the task that owns it; its ids go back to the blocks that hold it, where they are joined to
the texts by position. Ids become text again by a join with the vocabulary's table from id to piece, whose size is fixed,
and so it is sent to every task. Texts and ids pass through tasks as streams; a task holds a block, or its share of the
distinct words, which the number of shuffle partitions divides.

Defined cases: a null text counts as an empty one, which has no tokens and is decoded as an empty text; every row is a
text of its own, whether doc_ids repeat or are null; a text longer than a block is a block of its own; a word of any
length is encoded whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.llm.common import cut, partitions
from markwright.llm.vectors import IS_SPACE, LOWER, text_pieces


class Sizes(NamedTuple):
    """What bounds a task's memory; results don't depend on it."""

    #: Bytes of text in a row of codes.
    piece: int = 1 << 20
    #: Distinct words, bytes of these, and words after which a block ends.
    distinct: int = 1 << 19
    bytes: int = 1 << 25
    words: int = 1 << 23


SPACE, LETTER, DIGIT, MARK, WIDE = range(5)
CLASSES = np.array([SPACE if IS_SPACE[c] else WIDE if c > 127 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(256)], dtype=np.uint8)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    return own


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The vocabulary's table from id to piece."""
    own = tokenizer(path)
    return pa.array([own.id_to_token(i) for i in range(own.get_vocab_size())], pa.string())


def controls(path: str) -> list[bytes]:
    return [t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values()]


def split_words(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of the rows, in order, and how many each row has.

    A-Z become lower case where an ASCII character or the text's end follows: another one might compose with the capital.
    """
    n = len(data)
    cls = CLASSES[data]
    cuts = np.zeros(n + 1, dtype=bool)
    left, right = cls[:-1], cls[1:]
    apart = ((left != right) | (left == DIGIT)) & (left != WIDE) & (right != WIDE) & ~((data[:-1] == ord("'")) & (right == LETTER))
    cuts[1:n] = apart | ((left != right) & ((left == SPACE) | (right == SPACE)))
    raw = data.tobytes()
    for string in whole:
        at = raw.find(string)
        while at >= 0:
            cuts[at + 1 : at + len(string)] = False
            at = raw.find(string, at + 1)
    cuts[offsets] = True
    cuts[n] = True
    places = np.flatnonzero(cuts)
    solid = cls[places[:-1]] != SPACE
    before_wide = np.zeros(n, dtype=bool)
    before_wide[:-1] = cls[1:] == WIDE
    ends = offsets[1:-1]
    before_wide[ends[ends > 0] - 1] = False
    lower = np.where(before_wide, data, LOWER[data])
    spans = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(lower))
    counts = np.add.reduceat(np.append(solid, False), np.minimum(np.searchsorted(places, offsets[:-1]), len(solid))) if len(offsets) > 1 else np.zeros(0)
    return spans.filter(pa.array(solid)), np.where(np.diff(offsets) > 0, counts, 0).astype(np.int64)


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays or bytes as one compressed string, each with its length in bytes before it."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    packed = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
    return b"".join([np.array([[len(r), len(p)] for r, p in zip(raw, packed, strict=True)], dtype=np.int64).tobytes(), *packed])


def unpack(packed: bytes, *kinds: type) -> list:
    """What pack() was given, as arrays of these kinds."""
    sizes = np.frombuffer(packed, dtype=np.int64, count=2 * len(kinds)).reshape(-1, 2).tolist()
    at, out = 16 * len(kinds), []
    for (size, length), kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(pa.decompress(packed[at : at + length], size, codec="zstd", asbytes=True), dtype=kind))
        at += length
    return out


def pack_codes(codes: np.ndarray) -> bytes:
    """Small codes in a byte, others in three, few in five; bytes of a kind stand together, as they compress best."""
    rest = codes[codes >= 192] - 192
    top = np.minimum(rest >> 14, 62)
    first = codes.astype(np.uint8)
    first[codes >= 192] = 192 + top
    return pack(first, (rest & 255).astype(np.uint8), (rest >> 8 & 63).astype(np.uint8), rest[top == 62].astype(np.int32))


def unpack_codes(packed: bytes) -> np.ndarray:
    first, low, high, far = unpack(packed, np.uint8, np.uint8, np.uint8, np.int32)
    codes = first.astype(np.int32)
    large = codes >= 192
    top = codes[large] - 192
    rest = (top << 14) + (high.astype(np.int32) << 8) + low
    rest[top == 62] = far
    codes[large] = rest + 192
    return codes


def blocks(docs: DataFrame, path: str, key: str, text: str, shares: int, sizes: Sizes = Sizes()) -> DataFrame:
    """Rows of texts, (block, keys, lengths, codes), and of dictionaries, (block, codes, share, words): the words of a block that
    belong to one of the `shares` of all words, and their codes."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()),
        T.StructField("share", T.IntegerType()), T.StructField("words", T.BinaryType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, texts, size, n = TaskContext.get().partitionId() << 32, {}, [], 0, 0
        whole, shape = controls(path), None

        def row(codes: bytes, keys: pa.Array | None = None, lengths: pa.Array | None = None, share: int | None = None, words: bytes | None = None) -> pa.RecordBatch:
            lists = [pa.nulls(1, f.type) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x, f in ((keys, shape.field(1)), (lengths, shape.field(2)))]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, pa.array([codes], pa.binary()), pa.array([share], pa.int32()), pa.array([words], pa.binary())], schema=shape)

        def finished() -> Iterator[pa.RecordBatch]:
            """The rows of a block: codes are given anew, by how often a word occurs."""
            count = np.zeros(len(known), dtype=np.int64)
            for _, _, codes in texts:
                count += np.bincount(codes, minlength=len(known))
            rank = np.empty(len(known), dtype=np.int32)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(known))
            for keys, lengths, codes in texts:
                yield row(pack_codes(rank[codes]), keys, lengths)
            words = sorted(known)
            share = np.array([zlib.crc32(w.encode()) % shares for w in words], dtype=np.int64)
            code = rank[[known[w] for w in words]] if words else rank
            order = np.argsort(share, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if words else []:
                yield row(pack(code[some]), share=int(share[some[0]]), words=pack("\n".join([words[i] for i in some]).encode()))

        for batch in batches:
            if shape is None:
                shape = pa.schema([("block", pa.int64()), ("keys", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("share", pa.int32()), ("words", pa.binary())])
            for lo, hi, data, offsets in text_pieces(batch.column(1), sizes.piece):
                words, counts = split_words(data, offsets, whole)
                local = words.dictionary_encode()
                were = len(known)
                places = np.fromiter((known.setdefault(w, len(known)) for w in local.dictionary.to_pylist()), dtype=np.int32, count=len(local.dictionary))
                size += pc.sum(pc.binary_length(local.dictionary.filter(pa.array(places >= were)))).as_py() or 0
                # Copies, so that no batch is held by a slice of it.
                texts.append((pa.concat_arrays([batch.column(0).slice(lo, hi - lo)]), pa.array(counts.astype(np.int32)), places[local.indices.to_numpy()] if len(words) else places))
                n += len(words)
                if len(known) > sizes.distinct or size > sizes.bytes or n > sizes.words:
                    yield from finished()
                    block, known, texts, size, n = block + 1, {}, [], 0, 0
        if texts:
            yield from finished()

    return docs.select(key, F.coalesce(F.col(text), F.lit(""))).mapInArrow(work, schema)


def encode_words(dictionaries: DataFrame, path: str, shares: int) -> DataFrame:
    """(block, codes, ids) for (block, codes, share, words): each distinct word is encoded once, by the task that has its share.

    ids holds how many ids each code has, then the ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = tokenizer(path), {}
        for batch in batches:
            for block, codes, packed in zip(*batch.columns, strict=True):
                words = unpack(packed.as_py(), np.uint8)[0].tobytes().decode().split("\n")
                new = [w for w in words if w not in table]
                table.update(zip(new, (e.ids for e in own.encode_batch(new, add_special_tokens=False)), strict=True))
                ids = [table[w] for w in words]
                flat = np.array([i for x in ids for i in x], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([codes.as_py()], pa.binary()), pa.array([pack(np.array([len(x) for x in ids], dtype=np.int32), flat)], pa.binary())], ["block", "codes", "ids"])

    return dictionaries.repartitionById(shares, F.col("share")).select("block", "codes", "words").mapInArrow(work, "block long, codes binary, ids binary")


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def join_pieces(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """Each list's pieces, with a space between two."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, table.take(ids.values)), " ")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """(key, ids) for every row, and, if asked for, the text that the ids decode to."""
    shares = partitions(docs.sparkSession)
    parts = cut(blocks(docs, path, key, text, shares, sizes))
    nothing = F.lit(None)
    tables = encode_words(parts.where("share IS NOT NULL").select("block", "codes", "share", "words"), path, shares)
    tables = tables.select("block", F.lit(0).alias("kind"), nothing.cast(parts.schema["keys"].dataType).alias("keys"), nothing.cast("array<int>").alias("lengths"), "codes", "ids")
    texts = parts.where("share IS NULL").select("block", F.lit(1).alias("kind"), "keys", "lengths", "codes", nothing.cast("binary").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table = None, [], None
        for batch in batches:
            for i in range(len(batch)):
                here, kind, packed = (batch.column(c)[i].as_py() for c in (0, 1, 4))
                if here != block:
                    block, parts, table = here, [], None
                if kind == 0:
                    parts.append((unpack(packed, np.int32)[0], *unpack(batch.column(5)[i].as_py(), np.int32, np.int32)))
                    continue
                if table is None:
                    table = by_code(parts)
                    parts = []
                starts, counts, values = table
                codes, lengths = unpack_codes(packed), batch.column(3)[i].values.to_numpy()
                ids = gather(values, starts[codes], counts[codes]) if len(codes) else np.zeros(0, dtype=np.int32)
                ends = np.append(0, np.cumsum(counts[codes], dtype=np.int64))[np.append(0, np.cumsum(lengths))]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(2)[i].values, lists] + ([join_pieces(lists, pieces(path))] if decoded else []), ["key", "ids", "decoded"][: 2 + decoded])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: 2 + decoded])
    # Texts and the ids of their words meet by block; the ids come first.
    met = tables.union(texts).repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(work, schema).withColumnRenamed("key", key)


def by_code(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each code's ids start, how many they are, and the ids."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    codes, count, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(np.unique(codes)) != len(codes) or codes.max() + 1 != len(codes):
        raise RuntimeError("the words of a block did not come back once each")
    starts, counts = np.empty(len(codes), dtype=np.int64), np.empty(len(codes), dtype=np.int64)
    counts[codes] = count
    starts[codes] = np.cumsum(count, dtype=np.int64) - count
    return starts, counts, ids


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its lists of ids: each id joined with its piece, pieces joined by spaces; null for a null list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            flat = pa.ListArray.from_arrays(np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())).astype(np.int32), column.flatten())
            out = pc.if_else(column.is_valid(), join_pieces(flat, pieces(path)), None)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, text])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of what encode(decoded=True) returns."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
