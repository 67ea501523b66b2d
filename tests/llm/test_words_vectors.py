"""Operators 11 to 13 against the tokenizers library, brute force and plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import DATA
from tokenizers import Tokenizer

from markwright.llm import spelling, vector_codes, word_bpe
from markwright.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, block string, codes int, word string, n int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", 2) for i, t in rows], DOCS)


# --- operator 11

def library_digests(rows):
    own, out = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_word_bpe_equals_the_library_on_made_texts(spark):
    rng = random.Random(7)
    parts = list("abAB'sSt0123,.<|>-_  \n\ţ̱́̇éÉ漢字İΣσ…“’ \u0085　​")
    parts += ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'LL", "don't", "H̱", "한", "한", "\U0001f600", "ﬁ", "²", "Ⅷ", "٣"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(4000)]
    rows += [(None, None), (None, "no id"), (7, "an id that repeats"), (7, None), (8, "x" * 300_000 + " y"), (9, " a b" * 400_000), (10, "漢" * 50_000), (11, "<|endoftext|>" * 3)]
    got = word_bpe.digests(word_bpe.encode(docs_of(spark, rows), PATH, decoded=True))
    assert sorted(map(tuple, got.collect()), key=str) == library_digests(rows)


def test_codes_come_back_whatever_their_size():
    for codes in ([], [0], [191, 192, 193], np.arange(0, 3_000_000, 997), [192 + (62 << 14) - 1, 192 + (62 << 14), 2**31 - 1]):
        codes = np.array(codes, dtype=np.int32)
        assert (word_bpe.unpack_codes(word_bpe.pack_codes(codes)) == codes).all()


@pytest.mark.parametrize("sizes", [word_bpe.Sizes(500, 20, 1 << 25, 1 << 20), word_bpe.Sizes(1, 1 << 19, 40, 1 << 20), word_bpe.Sizes(50, 1 << 19, 1 << 25, 9)])
def test_word_bpe_small_blocks(spark, sizes):
    """Many blocks in a task, by each of the bounds."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) + rng.choice(["", ",", "."]) for _ in range(rng.choice([0, 1, 60])))) for i in range(300)]
    got = word_bpe.digests(word_bpe.encode(docs_of(spark, rows), PATH, decoded=True, sizes=sizes))
    assert sorted(map(tuple, got.collect()), key=str) == library_digests(rows)


def test_word_bpe_whole_table_and_decode(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = QUERIES["op11_word_bpe"](spark, f"{DATA}/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == library_digests([tuple(r) for r in docs.select("doc_id", "text").collect()])
    ids = word_bpe.encode(docs, PATH).selectExpr("doc_id", "if(doc_id % 7 = 0, null, ids) ids", "1 key")
    own = Tokenizer.from_file(PATH)
    for r in word_bpe.decode(ids, PATH).collect():
        assert r["decoded"] == (None if r["ids"] is None else own.decode(r["ids"], skip_special_tokens=False))
    assert word_bpe.encode(docs.limit(0), PATH).count() == 0


# --- operator 12

def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    shorter, near = defaultdict(set), defaultdict(set)
    for w in n:
        for p in range(len(w)):
            shorter[p, w[:p] + w[p + 1 :]].add(w)
    for (_, short), longer in shorter.items():
        for a in longer:
            near[a] |= longer - {a}
            if short in n:
                near[a].add(short)
                near[short].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("symbols", [None, 1, 2, 9])
def test_spelling_equals_brute_force(spark, symbols):
    rng = random.Random(symbols or 5)
    stems = ["".join(rng.choice("abcdtéÿ×") for _ in range(rng.randint(5, 12))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "x" * 3000, "x" * 3001]

    def word():
        w = list(rng.choice(stems[: rng.randint(1, len(stems))]))
        if rng.random() < 0.3:
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["q"], [w[p], "à"], [w[p].upper()]])
        return "".join(w)

    rows = [(i, " ".join(word() for _ in range(60)) + "1") for i in range(150)] + [(None, "abcdef " * 9), (None, None), (3, "abcdef,abcdeg " * 50), (3, "abcdef,abcdeg " * 50), (4, ""), (5, "chainsx " * 6 + "chainxx " * 40 + "chaiyxx " * 300)]
    got = spelling.group_variants(docs_of(spark, rows), symbols=symbols)
    want = brute_variants(rows)
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_spelling_whole_table_and_empty(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = QUERIES["op12_spelling_variants"](spark, f"{DATA}/sf0.001")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert spelling.group_variants(docs.limit(0)).collect() == []


def test_symbols_follow_the_vocabulary():
    assert [spelling.symbols_for(n) for n in (0, 1, 64 * 4**6, 64 * 4**6 + 1, 64 * 10**6)] == [4, 4, 4, 5, 10]


# --- operator 13

def loops(rows, parts=4, entries=256, rounds=4):
    kept = [(k, [min(max(int(np.floor(1024 * float(np.float32(x)))), -(2**27)), 2**27) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = sorted(((k, v + [0] * (parts * width - len(v)), label, v) for k, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(r[p]) for r in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r in cut:
                groups[best(r[p], books[p])[1]].append(r[p])
            for i, g in groups.items():
                books[p][i] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    coded = [[best(r[p], books[p]) for p in range(parts)] for r in cut]
    sums = Counter()
    for r, c in zip(kept, coded, strict=True):
        sums[r[2]] += sum(d for d, _ in c)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in c), sum(d for d, _ in c), sums[r[2]], sha) for r, c in zip(kept, coded, strict=True)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, __key int"


def coded(spark, rows):
    df = spark.createDataFrame([(k, v, label, "c", 1, 2) for k, v, label in rows], VECTORS)
    return sorted(map(tuple, vector_codes.digests(*vector_codes.compress(df)).collect()), key=str)


def test_vector_codes_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.05, 8).astype("float32").tolist(), int(i % 3)) for i in range(500)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [nan] * 8, 1), (903, [inf] + [0.0] * 7, None), (904, [-inf] * 8, 2), (905, [0.25] * 8, None), (906, [], None), (907, [0.5] * 5, 2), (None, [0.1] * 8, None)]
    rows += [(3, [0.3] * 8, 1), (3, [0.2] * 8, 1), (3, [0.2] * 8, 1)]
    assert coded(spark, rows) == loops(rows)


def test_vector_codes_few_equal_wide_and_far_values(spark):
    ties = [(i, [float(i % 2)] * 4, None) for i in range(9)]
    assert coded(spark, ties) == loops(ties)
    far = [(0, [1e30, -1e30, 3.0, 4.0], 1), (1, [5e4, -5e4, 3.5, 4.0], 1), (2, [0.0, 1.0, 2.0, 3.0], 2)]
    assert coded(spark, far) == loops(far)
    odd = [(i, [0.01 * i] * 6, 0) for i in range(5)]
    assert coded(spark, odd) == loops(odd)
    assert coded(spark, []) == [] and coded(spark, [(1, [], 1)]) == loops([(1, [], 1)])
