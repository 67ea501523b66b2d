"""Each stage of corpus_pipeline and run() against versions without Spark, with null and repeated ids and clashing columns."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))
from test_llm import edited, prose, true_components

import corpus_pipeline
from markwright.llm import language, near_dedup, pii, quality
from markwright.llm.common import stratified

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `__n` int, base string, component_id long, features string"
ITEM = prose(91, 40)
COPY = prose(92, 80)
TEXTS = [
    (1, COPY), (2, COPY), (3, edited(COPY, 40)), (3, prose(93, 60)), (3, prose(93, 60)), (None, prose(94, 50)), (None, prose(94, 50) + " " + ITEM), (5, prose(95, 30) + " " + ITEM + " " + prose(96, 300)), (6, None), (7, ""),
    (8, prose(97, 40) + " write to ann@mail.example.com or token = \"" + "0a1b2c3d4e" * 4 + "\" now"), (9, prose(98, 70)), (None, None), (10, "wow!!! &&& ### buy!! $$$ " * 9),
]


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def row(i, text):
    return (i, text, "en", ("a", "b", None)[len(text or "") % 3], len(text or ""), 77, 1, "clash", 5, "f")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([row(*t) for t in TEXTS], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    """Tables small enough to work through by hand: good prose against bad lines."""
    top = f"file://{tmp_path_factory.mktemp('tables')}"
    good, bad = [(100 + i, prose(200 + i, 60)) for i in range(60)], [(300 + i, f"wow!!! &&& ### buy!! $$$ {i} " * 12) for i in range(60)]
    every = docs.union(spark.createDataFrame([row(*t) for t in good + bad], SCHEMA))
    every.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def without_item(rows):
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = grams(spaced(ITEM.lower()))
    return Counter(r for r in rows.elements() if len(want & grams(spaced((r[1] or "").lower()))) < 0.8 * len(want))


def test_quality_stage(spark, docs, sf_dir):
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(every, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = corpus_pipeline.quality_filter(spark, every, sf_dir)
    assert kept.columns == every.columns
    good = {r["text"]: r["predicted"] for r in quality.score(every, model).join(every.select("doc_id", "text"), "doc_id").where("doc_id <> 3 AND doc_id IS NOT NULL").collect()}
    got, all_rows = counted(kept), counted(every)
    assert all(all_rows[r] == n for r, n in got.items())
    assert all((r in got) == bool(good[r[1]]) for r in all_rows if r[0] not in (3, None))
    assert sum(100 <= (r[0] or 0) < 200 for r in got) == 60 and not any((r[0] or 0) >= 300 for r in got)


def test_near_duplicate_stage(spark, docs, sf_dir):
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = counted(kept)
    assert max(got.values()) == 1 or all(r[0] is None for r, n in got.items() if n > 1)
    # Every row is judged by its group, whatever its id; rows without an id stay.
    named = [(i, t) for i, t in TEXTS if i is not None]
    groups = true_components([((i, k), t) for k, (i, t) in enumerate(named)], 5, 80)
    assert Counter((r[0], r[1]) for r in got.elements() if r[0] is not None) == Counter({t for k, t in enumerate(named) if groups[t[0], k][1] == (t[0], k)})
    assert Counter(r[1] for r in got.elements() if r[0] is None) == Counter(t for i, t in TEXTS if i is None)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    """No text goes because of its id: of each group one row stays, whatever ids its members share with other texts."""
    a, b = prose(301, 60), prose(302, 60)
    keep = lambda rows: sorted(map(tuple, corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()))
    assert keep([(1, a), (5, a), (5, b), (9, b)]) == [(1, a), (5, b)]
    assert keep([(1, a), (5, a + " extra"), (5, b)]) == [(1, a), (5, b)]
    assert len(keep([(5, a), (5, b), (8, a + " more"), (9, b + " more")])) == 2
    assert len(keep([(5, a), (5, a + " extra"), (5, a.upper()), (5, a)])) == 1
    assert keep([(7, prose(400 + i, 40)) for i in range(200)]) == sorted((7, prose(400 + i, 40)) for i in range(200))
    got = near_dedup.near_duplicates(spark.createDataFrame([(5, a), (5, b), (8, a + " more"), (9, b + " more")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False)]


def test_decontamination_stage(spark, docs, sf_dir):
    kept = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    assert kept.columns == docs.columns and counted(kept) == without_item(counted(docs))
    assert kept.count() == len(TEXTS) - 2


def test_personal_data_stage(spark, docs, sf_dir):
    clean = corpus_pipeline.redact_personal_data(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    want = Counter()
    for i, t in TEXTS:
        new = t and re.sub(r'(?<=token = ")[0-9a-f]{40}', "<SECRET>", t.replace("ann@mail.example.com", "<EMAIL>"))
        want[row(i, t)[:1] + (new,) + row(i, t)[2:4] + (len(new) if new is not None else row(i, t)[4],) + row(i, t)[5:]] += 1
    assert counted(clean) == want


def test_mix_stage(spark, docs, sf_dir):
    done = corpus_pipeline.mix(spark, docs, sf_dir)
    assert done.columns == [*(c for c in docs.columns if c != "size"), "size", "source_size", "target", "taken"]
    texts = Counter((i, t) for i, t in TEXTS)
    for r in done.collect():
        assert texts[r["doc_id"], r["text"]] and r["size"] == len(spaced(r["text"])) and 0 < r["taken"] <= 2 * r["size"] and r["base"] == "clash"


def test_run_is_its_stages_one_after_the_other(spark, docs, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    rows = got.collect()
    assert not any(t in (r["text"] or "") for r in rows for t in ("ann@mail", ITEM, "wow!!!")) and len({r["doc_id"] for r in rows if r["doc_id"] in (1, 2)}) <= 1
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, sf_dir).collect(), stage(spark, step, sf_dir).schema)
    assert counted(got) == counted(step)


def test_every_stage_takes_an_empty_table(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).isEmpty()


def test_texts_of_a_megabyte_go_whole_through_every_stage(spark, sf_dir):
    long = prose(500, 200_000)
    holds = prose(501, 150_000) + " " + ITEM + " " + prose(502, 100_000) + " write to ann@mail.example.com"
    assert min(len(long), len(holds)) > 1_000_000
    d = spark.createDataFrame([row(i, t) for i, t in ((1, long), (2, long + " one more"), (3, holds), (4, prose(503, 60)))], SCHEMA).repartition(2).persist()
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.near_duplicates(spark, d, sf_dir)) == [1, 3, 4]
    assert ids(corpus_pipeline.decontaminate(spark, d, sf_dir)) == [1, 2, 4]
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_personal_data(spark, d, sf_dir).select("doc_id", "text").collect()}
    assert clean == {1: long, 2: long + " one more", 3: holds.replace("ann@mail.example.com", "<EMAIL>"), 4: prose(503, 60)}
    sizes = {r["doc_id"]: r["size"] for r in corpus_pipeline.mix(spark, d, sf_dir).select("doc_id", "size").collect()}
    assert sizes and all(n == len(spaced(clean[i])) for i, n in sizes.items() if i != 3)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(d, language.fit(d)).collect()}
    assert set(got.values()) <= {"en", "und"} and len(got) == 4
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r["doc_id"]: 0 <= r["score"] <= 1 for r in quality.score(d, model).collect()} == dict.fromkeys((1, 2, 3, 4), True)


# The learned operators against forward passes of their own.
def test_every_quality_score_is_the_models(spark, sf_dir):
    """Scores of the table, in pieces of many texts, against each text described alone and passed through the model."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(every, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = Counter()
    for r in every.collect():
        data = np.frombuffer((r["text"] or "").encode(), dtype=np.uint8)
        x = quality.describe(data, np.array([0, len(data)]))[0].astype(np.float64)
        z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
        z[len(quality.NAMES) :] *= quality.WORD_WEIGHT
        score = 1 / (1 + np.exp(-np.clip((z @ model["w"] - model["threshold"]) * model["slope"], -30, 30)))
        want[r["doc_id"], round(float(score), 5), int(score >= 0.5)] += 1
    assert Counter((r["doc_id"], round(r["score"], 5), r["predicted"]) for r in quality.score(every, model).collect()) == want


def test_language_scores_by_hand(spark, docs):
    texts = ["The river, É über!", "le fleuve et les ponts", "", "½ ² Ⅷ", None, "x", "The river, É über!"] + [f"the old stone bridge {i} stands" for i in range(30)] + [f"le vieux pont {i} de pierre" for i in range(30)]
    langs = ["en", "fr", "en", None, "en", None, "en"] + ["en"] * 30 + ["fr"] * 30
    d = spark.createDataFrame(list(zip(range(len(texts)), texts, langs, strict=True)), "doc_id long, text string, lang string")
    model = language.fit(d)
    for r in language.predict(d, model).collect():
        text = texts[r["doc_id"]] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        # Letters fold to lower case, all but letters of ASCII to one blank; blanks in a row give no subword.
        folded = [b | 32 if chr(b).isascii() and chr(b).isalpha() else b if b >= 128 else 32 for b in text.encode()] + [32, 32, 32]
        sums, n = np.zeros(model["rows"].shape[1]), 0
        for i in range(len(folded) - 3):
            if folded[i] == folded[i + 1] == 32:
                continue
            a, b, c, e = folded[i : i + 4]
            three = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            four = (three * 0x27D4EB2F ^ e * 0x165667B1) & 0xFFFFFFFF
            for place in ((three * 0x2C1B3C6D & 0xFFFFFFFF) >> 17, (four * 0x297A2D39 & 0xFFFFFFFF) >> 17):
                sums += model["rows"][place]
            n += 2
        z = (sums / n @ model["head"] + model["bias"]) / model["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model["langs"][int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4


def test_quality_scores_by_hand(spark, sf_dir):
    every, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(every, labels)
    rows = quality.score(every, model).join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) == len(good) * len(bad)  # each pair in the right order
    # As large a part of the labelled rows that may be learned from falls under the threshold as has quality 0.
    learned = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] < 0.5 for r in learned) == sum(r["quality"] == 0 for r in learned)
    text = "Wow!! it is 7 up, up"
    x = quality.describe(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))[0]
    by = dict(zip(quality.NAMES, x[: len(quality.NAMES)], strict=True))
    n = len(text)
    assert np.allclose([by["upper"], by["digit"], by["mark"], by["stop"]], [1 / n, 1 / n, 2 / n, 1 / n])
    assert np.isclose(by["word_length"], np.mean([5, 2, 2, 1, 3, 2]) / 10) and np.isclose(by["distinct"], 1.0) and np.isclose(by["marked_words"], 1 / 6)
    assert np.isclose((x[len(quality.NAMES) :] ** 2).sum(), 1)


def test_many_languages_share_the_embeddings(spark):
    """With more languages than an embedding has numbers the layers stay apart; the table that is sent out stays as large."""
    rng = np.random.default_rng(2)
    rows = [(100 * i + j, " ".join(f"{chr(97 + i % 26)}{'aeiou'[i // 26]}{'xyz'[w]}" for w in rng.integers(0, 3, 60)), f"l{i}") for i in range(40) for j in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d)
    assert len(model["langs"]) == 40 and model["rows"].shape == (language.TABLE, language.DIM) and model["head"].shape == (language.DIM, 40)
    got = language.predict(d, model).join(d, "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) a").first()["a"]
    assert got > 0.9


def test_the_sample_keeps_its_bound(spark):
    shared = spark.createDataFrame([(1 if i % 2 else None, f"text {i}", f"l{i % 2}") for i in range(20_000)], "doc_id long, text string, lang string")
    assert stratified(shared, "lang", 600).groupBy("lang").count().collect() in ([("l0", 300), ("l1", 300)], [("l1", 300), ("l0", 300)])
    assert stratified(shared, "lang", 600).exceptAll(stratified(shared.repartition(7), "lang", 600)).isEmpty()
    copies = spark.range(30_000).selectExpr("7 doc_id", "'the same' text", "'en' lang")
    assert stratified(copies, "lang", 600).count() == 1
    many = spark.range(20_000).selectExpr("id doc_id", "'t' text", "concat('l', id % 10000) lang")
    assert stratified(many, "lang", 6000).count() == 6000
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    texts = spark.range(9000).selectExpr("if(id % 2 = 0, 1, 7) doc_id", "concat('a text ', id) text")
    held = [r["doc_id"] for r in labels.selectExpr("doc_id", "crc32(cast(doc_id as string)) % 3 = 1 h").where("NOT h").collect()]
    assert held == [1, 7]
    rows = quality.cut(quality.described(texts.join(labels.selectExpr("doc_id", "quality label"), "doc_id"), "doc_id", "label"))
    assert stratified(rows, "label", 100).count() == 100 and quality.fit(texts, labels, bound=100) is not None


def test_rows_that_repeat_an_id_are_scored_each(spark, sf_dir):
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = spark.createDataFrame([(1, prose(3, 60)), (1, "wow!!! &&& ### buy!! $$$ " * 12), (None, prose(3, 60)), (1, prose(3, 60))], "doc_id long, text string")
    got = Counter((r["doc_id"], r["predicted"]) for r in quality.score(d, model).collect())
    assert got == {(1, 1): 2, (1, 0): 1, (None, 1): 1}


def test_long_secrets_and_addresses_go_whole(spark):
    """Nothing of a value stays behind its mark, however long it is; names of columns are free."""
    long = {"token: " + "aB3" * 250: "aB3", "secret = " + "f9" * 5000: "f9f9", "mail " + "x1" * 200 + " (at) " + "h" * 90 + " (dot) org": "x1x1", "api_key=" + "Q7z" * 200_000: "Q7z"}
    d = spark.createDataFrame([(i, f"{prose(i, 20)} {t} {prose(i, 9)}", "a", 1, [2], [3]) for i, t in enumerate(long)], "doc_id long, text string, `__cand` string, `__base` int, `__spans` array<int>, `row` array<int>")
    clean = pii.redact(d)
    assert clean.columns == d.columns and clean.dtypes == d.dtypes
    for r, left in zip(sorted(clean.collect()), long.values(), strict=True):
        assert left not in r["text"] and "<" in r["text"] and r["text"].startswith(prose(r["doc_id"], 20)) and r["text"].endswith(prose(r["doc_id"], 9))
        assert (r["__cand"], r["__base"], r["__spans"], r["row"]) == ("a", 1, [2], [3])


def test_planted_personal_data_is_found_and_the_rest_left(spark):
    planted = [f"{prose(i, 40)} {x} {prose(i + 1, 30)}" for i, x in enumerate(("bob.lee@mail3.example.com", "10.20.30.41", "4111 1111 1111 1111", "+1 (375) 555-4393", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "api_key: Zx81kQp0Lm93vB7tRw2Y", "carol (at) host (dot) org", "192[.]168[.]7[.]9", "bob at example dot com", "2001:db8::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"))]
    clean = [prose(50, 90), "on 2024-05-17 at 10:30 we sold 1,250,000 of 3.5", "see chapter 12.4.7 and page 4096", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "the password = something", "4111 1111 1111 1112", "300.400.500.600", "the token: everything goes", "we met at noon dot", "use std::vector or a::b", "at 12:30:45 sharp"]
    d = spark.createDataFrame(list(enumerate(planted + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_spans"] for r in pii.counts_and_digests(pii.find(d)).collect()}
    assert sum(got[i] > 0 for i in range(len(planted))) >= 0.9 * len(planted)
    assert all(got[i] == 0 for i in range(len(planted), len(got)))


def described_by_hand(texts):
    return np.stack([quality.describe(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]).astype(np.float64)


def test_quality_learns_from_every_label(spark):
    """More labels than a driver's sample held: means, scales and threshold are those of all rows that may be learned from."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{'aeiou'[i % 5] * (i % 7 + 1)}{i}" + ("!" if i % 9 == 0 else "") for i in range(300)])
    kinds = rng.integers(0, 4, 12_000)
    rows = [(i, " ".join(words[(rng.integers(0, 120 + 40 * int(k), 12)) % 300]), int(k > 0)) for i, k in enumerate(kinds.tolist())]
    every = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    docs, labels = every.select("doc_id", "text"), every.select("doc_id", "quality")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("NOT held_out").collect()
    learned = [rows[r["doc_id"]] for r in got]
    x = described_by_hand([t for _, t, _ in learned])
    assert len(got) > 7000 and np.allclose(model["mean"], x.mean(axis=0), atol=1e-5) and np.allclose(model["scale"], x.std(axis=0) + 1e-3, atol=1e-4)
    assert sum(r["score"] < 0.5 for r in got) == sum(r["quality"] == 0 for r in got)


def test_quality_weighs_all_pairs(spark, sf_dir):
    """The same rounds over every pair written out."""
    every, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    noise = labels.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    model = quality.fit(every, noise)
    known = every.join(noise, "doc_id").where("crc32(cast(doc_id as string)) % 3 <> 1").collect()
    z = quality.scaled(described_by_hand([r["text"] for r in known]), model)
    y = np.array([r["quality"] for r in known])
    diff = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    curve = diff.T @ diff / len(diff) / 4 + quality.DECAY * np.eye(z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(quality.ROUNDS):
        w = w + np.linalg.solve(curve, (diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) - quality.DECAY * w)
    assert np.abs(model["w"] - w).max() < 0.01 * np.abs(w).max()
    assert np.isclose(model["slope"], 4 / (z @ w).std(), rtol=0.01)


def test_quality_model_does_not_depend_on_how_rows_are_dealt(spark, sf_dir, monkeypatch):
    every, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = quality.fit(every, labels)
    other = quality.fit(every.repartition(7), labels.repartition(3))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = quality.fit(every, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for model in (other, shuffled):
        assert all(np.array_equal(want[k], model[k]) for k in want)


def test_repeated_labels_and_ids_count_each(spark, sf_dir):
    """Labels that come three times over are the model of once; a document in two rows is learned from twice."""
    every, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id >= 100"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = quality.fit(every, labels)
    thrice = quality.fit(every, labels.union(labels).union(labels))
    assert np.allclose(want["w"], thrice["w"], atol=1e-4) and np.isclose(want["threshold"], thrice["threshold"], atol=1e-3)
    twice = quality.fit(every.union(every.where("doc_id = 101")), labels)
    again = quality.fit(every, labels.union(labels.where("doc_id = 101")))
    assert all(np.array_equal(twice[k], again[k]) for k in twice) and not np.array_equal(want["mean"], twice["mean"])


@pytest.mark.parametrize("spread", [1, 50, 10**9])
def test_threshold_is_the_exact_rank(spark, monkeypatch, spread):
    monkeypatch.setattr(quality, "SPANS", 4)
    values = sorted(np.round(np.random.default_rng(spread).normal(size=200) * spread).tolist() + [1e-300, 3e-300, 1e12])
    counts = [1 + i % 3 for i in range(len(values))]
    line = [v for v, n in zip(values, counts, strict=True) for _ in range(n)]
    scores = spark.createDataFrame(list(zip(values, counts, strict=True)), "score double, n long").persist()
    for below in (1, 2, 100, 201, len(line) - 1):
        assert quality.split_at(scores, below) == (line[below - 1], line[below])
