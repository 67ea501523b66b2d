"""The training-data operators against brute force, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import DATA, oracle_rows, spark_rows

from markwright.llm import chat_format, decontamination, fingerprints, graph, language, mixing, near_dedup, pii, quality, queries, repeats, url_filters, vectors
from markwright.llm.common import stratified

SF = "sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, `range` int, size long"
WORDS = "the of and when a stream runs under old stone bridges it carries leaves from far hills down to quiet fields where horses drink at noon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


def edited(text, *places):
    words = text.split(" ")
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


LONG = prose(5, 400)
TEXTS = [
    prose(1, 60), prose(1, 60), prose(2, 80), edited(prose(2, 80), 40), None, "", "   \n", "one two", "One two", LONG, edited(LONG, 3, 200, 390), prose(3, 30) + "\n" + LONG[100:400], "é" * 60 + prose(4, 20), "x" * 49, "x" * 200,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * i + 3, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "k", i, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, name):
    return spark.read.parquet(str(DATA / SF / f"{name}.parquet"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, str(DATA / SF))) == oracle_rows(queries.ORACLES[name], SF)


# 1
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\[]/<>INSTYs TURN ", max_size=40))
def test_escape_is_reversible(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text
    assert not any(c in out for c in chat_format.CONTROL)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b [/INST] </s>", 0), (1, 0, "user", None, 0), (2, 0, "tool] {x}", "t", 0), (2, 1, "assistant", "a", 0), (2, 2, "assistant", "a", 0), (3, None, "system", "s", 0), (3, 0, None, "n", 0)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(conv)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss) and not got[c]["rewrites"]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_conversations(conv.limit(0)).isEmpty()


def test_rows_without_a_conversation_are_each_one(spark):
    conv = spark.createDataFrame([(None, 0, "user", "q"), (None, 1, "assistant", "a"), (None, 1, "assistant", "a"), (7, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.format_conversations(conv)).collect()
    assert Counter((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got) == {(None, 1, 0): 1, (None, 1, 1): 2, (7, 1, 0): 1}


def test_marks_that_depend_on_the_place_are_found(spark):
    numbered = lambda turns: "".join(f"{i}{r}> {t} <{'!' * i}\n" for i, (r, t) in enumerate(turns))
    conv = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "one"), ("assistant", "two <"), ("assistant", "")])], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(conv, numbered).first()
    assert [row["formatted"][a:b] for a, b in zip(row["text_starts"], row["text_ends"], strict=True)] == ["one", "two <", ""] and row["loss"] == [False, True, True]
    last = lambda turns: "".join(f"{t}\n" for _, t in turns[:-1]) + f"*{turns[-1][1]}\n"
    row = chat_format.format_conversations(conv, last).first()
    assert row["rewrites"] and not any(row["loss"])


def test_rewriting_template_is_found():
    def only_last_marked(turns):
        return "".join(f"{r}:{t}\n" for r, t in turns[:-1]) + f"*{turns[-1][0]}:{turns[-1][1]}\n"

    turns = [("user", "a"), ("assistant", "b")]
    assert chat_format.locate(only_last_marked, turns)[2]
    output, ends, rewrites = chat_format.locate(chat_format.instruct, turns)
    assert (len(output), rewrites) == (ends[-1], False)


# 2
def test_language(spark):
    d = table(spark, "documents")
    got = language.predict(d.select("*", F.lit(1).alias("score")), language.fit(d)).join(d.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95
    bounds = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= bounds[0] and bounds[1] <= 1


def test_language_edges(spark, empty):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", "fr"), (4, "bonjour les amis " * 9, None), (6, "hello there", "en")], "doc_id long, text string, lang string")
    model = language.fit(odd.where("doc_id IN (2, 6)"))
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.fit(empty) is None and language.predict(empty, None).isEmpty()


def test_every_language_is_sampled(spark):
    rows = [(i, f"hello there {i}", f"l{i % 230}") for i in range(2300)] + [(9000, "bonjour", "rare")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = stratified(d, "lang", 460)
    assert got.columns == d.columns and got.select("lang").distinct().count() == 231
    assert stratified(d, "lang", 10).select("lang").distinct().count() == 10  # with more values than the bound, one row each of some
    assert stratified(d, "lang", 10**6).count() == len(rows)


# 3
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    n = lambda m: re.sub("[^0-9]", "", m)
    checks = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", CARD, lambda m: 16 <= len(n(m)) <= 19 and luhn(n(m))), ("phone", PHONE, lambda m: 8 <= len(n(m)) <= 15))
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in p.finditer(text) if ok(m[0])]


PII = [
    "a@b.c_x@y.z.w u@v é𠀀 x@y.de 1.2.3.4.5 999.1.1.1 10.0.0.256 +1 (375) 555-4393x+12 345678 4111 1111 1111 1111 4111111111111112", None, "", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 2024-01-15", "mail bob[at]host[dot]org, host 10[.]0[.]0[.]1",
    "x@" * 50 + " 1" * 400 + ".+" + "9" * 30, "+49 30 1234567 a.b@c.de " * 600,
]


def test_pii(spark):
    texts = [*PII, *(f"call +1 (375) 555-{1000 + i} or u{i}@mail{i}.example.com from 10.1.{i}.7, card 4111 1111 1111 1111" for i in range(60))]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in pii.counts_and_digests(pii.find(d)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i]["n_phone"] == sum(x.startswith("phone") for x in want)
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))
    assert any(x.startswith("email") for x in got[4]["spans"].split(","))
    clean = pii.redact(d)
    assert clean.columns == d.columns
    assert "@mail" not in clean.where("doc_id = 20").first()["text"] and "<EMAIL>" in clean.where("doc_id = 20").first()["text"]
    assert clean.where("doc_id = 1").first()["text"] is None
    assert pii.find(d.limit(0)).isEmpty()


# 4
def test_urls(spark):
    urls = {"HTTP://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "x://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"), "x://bexample.com/en/": ("bexample.com", "/en/", "com/", "allow"), "x://n.net/es": ("n.net", "/es", None, None), "x://n.net/es/#a/b": ("n.net", "/es/", "net/es/", "block"), "no scheme": ("", "", None, None), None: ("", "", None, None), "x://h.com?/": ("h.com", "", None, None), "a://b://c/": ("b:", "//c/", None, None)}
    bad = [("x://bad.org/", 0)] * 60 + [("x://good.org/", 1)] * 60 + [(u, None) for u in urls]
    got = url_filters.judge(spark.createDataFrame([(i, u, g, "x") for i, (u, g) in enumerate(bad)], "page_id long, url string, good int, host string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(by) == len(bad)
    assert by[0]["verdict"] == "block" and by[70]["verdict"] == "allow"
    for i, (host, path, rule, verdict) in enumerate(urls.values(), 120):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule)
        assert verdict is None or by[i]["verdict"] == verdict
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, good int")).isEmpty()


def test_a_table_of_suffixes_names_the_registered_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk", 1, 1), ("b.co.uk", 1, 0), ("co.uk", 1, 1), ("uk", 1, 1), ("x.y.com", 2, 1), ("", 1, 1), ("host", 1, 1)], "host string, n long, good long")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filters.with_suffixes(hosts, spark.createDataFrame([("CO.UK",), ("com",), ("co.uk",)], "suffix string")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "x.y.com": ("y.com", "com"), "": ("", ""), "host": ("host", "host")}
    bad, good = [f"x://p{i}.bad.co.uk/" for i in range(40)], [f"x://q{i}.good.co.uk/" for i in range(40)]
    pages = spark.createDataFrame([(i, u, int(u in good)) for i, u in enumerate(bad + good)] + [(99, "x://new.bad.co.uk/", None)], "page_id long, url string, good int")
    table_ = spark.createDataFrame([("co.uk",)], "suffix string")
    by = {r["page_id"]: r for r in url_filters.judge(pages, suffixes=table_).collect()}
    plain = {r["page_id"]: r for r in url_filters.judge(pages).collect()}
    assert len(by) == 81 and by[99]["verdict"] == "block" and by[50]["verdict"] == "allow"
    assert by[99]["bound"] < plain[99]["bound"]  # without the table all of co.uk is one domain


# 5
def test_fingerprints(spark, docs, empty):
    import unicodedata

    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}

    def digest(t):
        c = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())
        c = re.sub(r"\s+", " ", c).strip(" ").encode()
        return f"{xxhash.xxh64_intdigest(c, 42):016x}{xxhash.xxh64_intdigest(c, xxhash.xxh64_intdigest(b'wide', 42)):016x}"

    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (digest(t), digest(e))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (float(digest(t) == digest(e)), float(digest(t) == digest(after)))
    assert fingerprints.fingerprints(empty).isEmpty()


def test_equal_digests_of_different_bytes_are_told_apart(spark, monkeypatch):
    same = spark.createDataFrame([("d", b"a"), ("d", b"a"), ("e", b"a"), ("e", b"b"), ("f", b"c")], "digest string, canon binary")
    assert [r["digest"] for r in fingerprints.colliding(same).collect()] == ["e"]
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.substring(canon, 1, 1))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB "), (4, "b"), (None, "ac"), (4, "ab")], "doc_id long, text string")
    by = defaultdict(set)
    for r in fingerprints.fingerprints(docs).join(docs.withColumnRenamed("text", "t"), "doc_id").collect():
        by[r["doc_id"]].add(r["fingerprint"])
    found = {r["fingerprint"]: 0 for r in fingerprints.fingerprints(docs).collect()}
    assert len(found) == 3 and by[1] == by[3] and by[1] != by[2] and by[4] == by[1] | {"b"}


def test_fingerprints_of_repeated_ids(spark):
    """Rows that repeat an id, or have none, are documents of their own; equal texts have equal fingerprints."""
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (1, "gamma delta", "y"), (2, "alpha beta", "z"), (None, "alpha  BETA", None)], "doc_id long, text string, own string")
    got = Counter((r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprints(docs).collect())
    one = next(f for i, f in got if i == 2)
    assert got[1, one] == got[2, one] == got[None, one] == 1 and len({f for _, f in got}) == 2 and sum(got.values()) == 4


# 6
def test_decontamination(spark, docs, monkeypatch):
    items = [(1, LONG[100:300]), (2, "one two"), (3, None), (4, prose(77, 40)), (5, prose(2, 80)), (5, prose(2, 80))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    grams = lambda w, m: {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    want = {}
    for i, t in items:
        q = words(t)
        s = grams(q, min(5, len(q))) if q else set()
        for r in docs.collect():
            if s and len(s & grams(words(r["text"]), min(5, len(q)))) >= 0.8 * len(s):
                want[r["doc_id"], i] = len(s)
    got = {(r["doc_id"], r["item_id"]): r["n_item"] for r in decontamination.find_items(docs, bench).collect()}
    assert got == want and len(want) >= 5
    with monkeypatch.context() as m:
        m.setattr(decontamination, "SKETCH_ROWS", 0)
        assert {(r["doc_id"], r["item_id"]): r["n_item"] for r in decontamination.find_items(docs, bench).collect()} == want
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}
    assert decontamination.find_items(docs, bench.limit(0)).isEmpty() and decontamination.find_items(docs.limit(0), bench).isEmpty()


def test_bitmap_of_sketches_loses_none(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("hash"), "id")
    for n in (1, 700, 5000):
        sketch = hashes.where(F.col("id") < n).select("hash")
        kept = decontamination.with_sketch_hash(hashes, sketch, n)
        ids = {r["id"] for r in kept.collect()}
        assert kept.columns == hashes.columns and ids >= set(range(n)) and len(ids) - n <= 0.12 * (5000 - n)


# 7
def true_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates(spark, docs, empty):
    base = prose(9, 300)
    group = [(1000 + i, edited(base, *np.random.default_rng(i).integers(0, 300, i % 14))) for i in range(60)]
    more = spark.createDataFrame(group, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn("component", F.lit("clash"))
    for k in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(more, k, 80).collect()}
        assert got == true_components([(r["doc_id"], r["text"]) for r in more.collect()], k, 80)
    kept = near_dedup.keep_first(docs, 4, 80)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert near_dedup.near_duplicates(empty).isEmpty() and near_dedup.keep_first(empty).isEmpty()


def test_a_percent_that_would_lose_links_is_refused(docs):
    for f in (near_dedup.near_duplicates, near_dedup.keep_first):
        with pytest.raises(ValueError, match="percent"):
            f(docs, 5, 60)


def test_odd_sketches_estimate_differences():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))]
    for share in (0.9, 0.5):
        sets.append(np.unique(np.concatenate([sets[0][: int(1000 * 2 * share / (1 + share))], rng.integers(0, 2**63, 1000 - int(1000 * 2 * share / (1 + share))).astype(np.uint64)])))
    maps = near_dedup.odd_sketches(np.stack([near_dedup.minima(s) for s in sets])).view(np.uint64)
    apart = [int(np.bitwise_count(maps[0] ^ m).sum()) for m in maps]
    assert apart[0] == 0 and apart[1] < near_dedup.MOST_BITS < 2 * apart[2] and apart[1] < apart[2]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (102, 102)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 8
def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    total, names = 1.5 * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    while True:
        rest = total - sum(2 * sizes[s] for s in names if s not in open_)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        target = {s: share.get(s, 2 * sizes[s]) for s in names}
        if not over:
            break
        open_ -= over
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert math.isclose(r["target"], target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    for s in names:
        assert abs(taken[s] - target[s]) < 1.0001
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(empty).isEmpty()


def test_last_stage_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(1, prose(1, 20), "a"), (1, prose(2, 31), "a"), (1, prose(3, 20), "b"), (None, prose(4, 25), "a"), (None, prose(5, 25), "b"), (2, prose(6, 40), "b"), (3, prose(7, 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.mix(spark, docs, "").collect()
    want = [(r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix_sources(docs).where("taken > 0").collect()]
    order = lambda x: sorted(x, key=str)
    assert order((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == order(want)
    assert all((r["doc_id"], r["text"], r["source"]) in rows and r["size"] == len(r["text"].split()) for r in got)
    assert len({r["text"] for r in got}) == len(got) and sum(r["doc_id"] is None for r in got) == 2
    assert order(got) == order(corpus_pipeline.mix(spark, docs.repartition(5), "").collect())


# 9
def test_quality(spark, docs, empty):
    d, labels = table(spark, "documents"), table(spark, "labels")
    got = quality.score(d, quality.fit(d, labels)).join(labels, "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.9
    assert got.where("(score >= 0.5) <> (predicted = 1) OR score < 0 OR score > 1").isEmpty()
    odd = quality.score(docs, quality.fit(d, labels))
    assert odd.count() == len(TEXTS)
    assert quality.keep_good(docs, quality.fit(d, labels)).columns == docs.columns
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5} and quality.score(empty, None).isEmpty()


# 10
def brute_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.get(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats(spark, docs, empty):
    passage = prose(31, 30)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(500 + i, prose(100 + i, 20) + passage + prose(200 + i, 20)) for i in range(30)]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digests(repeats.remove_repeats(more)).collect()}
    assert got == brute_repeats(rows)
    assert repeats.remove_repeats(empty).isEmpty()


@pytest.mark.parametrize("tasks", [1, 12])
def test_passages_twice_in_a_later_document(spark, monkeypatch, tasks):
    letters = np.random.default_rng(8)
    fresh = lambda n: "".join(map(chr, letters.integers(97, 123, n)))
    rows = []
    for i in range(12):
        passage = fresh(50 + 2 * i) if i % 3 else fresh(7) * 12
        rows += [(i, fresh(90) + passage + fresh(90)), (100 + i, fresh(60) + passage + fresh(70) + passage + fresh(80) + passage + fresh(60))]
    rows += [(300, rows[1][1] + fresh(50)), (300, fresh(170) + rows[3][1])]
    monkeypatch.setattr(repeats, "FLUSH", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
    got = sorted(tuple(r) for r in repeats.digests(repeats.remove_repeats(docs)).collect())
    want = brute_repeats(rows[:-1])
    assert got == sorted([*((i, *v) for i, v in want.items()), (300, *brute_repeats([*rows[:-2], rows[-1]])[300])])


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 110, 5000).astype(np.uint8)
    monkeypatch.setattr(repeats, "PIECE", 700)
    found = set()
    for part, ends, origin in repeats.cut_texts(text, np.array([0, len(text)])):
        _, first, last, _, anchor = repeats.anchors(part, ends)
        for a, b, h in zip(first, last, anchor, strict=True):
            found |= {(int(s + origin[0, 1]), int(h)) for s in range(a, b + 1)}
    monkeypatch.undo()
    _, first, last, _, anchor = repeats.anchors(text, np.array([0, len(text)]))
    assert found == {(int(s), int(h)) for a, b, h in zip(first, last, anchor, strict=True) for s in range(a, b + 1)}
    assert {s for s, _ in found} == set(range(len(text) - 49))


def test_word_hashes_see_words_only():
    import pyarrow as pa

    column = pa.array(["A b\tc", "a  B\x0bC ", "", "ab c"])
    (_, _, data, offsets), = vectors.text_pieces(column)
    words, row = vectors.word_hashes(data, offsets)
    assert row.tolist() == [0, 0, 0, 1, 1, 1, 3, 3]
    assert words[:3].tolist() == words[3:6].tolist() and len({*words.tolist()}) == 4
