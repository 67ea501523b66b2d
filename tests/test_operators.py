import hashlib
import random
import time
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markwright.functions import text as X
from markwright.operators import contracts, diff, evaluate, integrity, keys, lint, order, pages, rules, terms
from markwright.sources import files

LINE = st.lists(st.sampled_from("abc"), max_size=8)


@settings(max_examples=200, deadline=None)
@given(LINE, LINE)
def test_script_turns_before_into_after(a, b):
    lines = diff.script(a, b)
    assert [x[1:] for x in lines if x[0] in " -"] == a
    assert [x[1:] for x in lines if x[0] in " +"] == b


def test_script_puts_additions_first_on_a_tie():
    assert diff.script(["x"], ["y"]) == ["+y", "-x"]


def test_diff_report(spark):
    pairs = spark.createDataFrame([(1, "# 答案\n\n1. C\n2. B", "# 答案\n\n1. D\n2. B"), (2, "a\r\nb", "a\nb\n"), (3, None, "")], "pair_id long, before_text string, after_text string")
    got = {r["pair_id"]: r for r in diff.diff_report(pairs).collect()}
    assert (got[1]["added"], got[1]["removed"], got[1]["changed"]) == (1, 1, True)
    assert not got[2]["changed"] and got[2]["before_sha256"] != got[2]["after_sha256"]
    assert not got[3]["changed"]


def test_large_pairs_are_reported(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "d\ne\nf")], "pair_id long, before_text string, after_text string")
    assert diff.line_diff(pairs, max_cells=8).first()["too_large"]


def test_long_pairs_are_diffed(spark):
    same = "".join(f"line {i}\n" for i in range(20_001))
    other = "\n".join(f"new {i}" if i % 1000 else f"line {i}" for i in range(20_001))
    rows = [(1, same + "a", same + "b"), (2, same, other)]
    got = {r[0]: tuple(r)[1:] for r in diff.line_diff(spark.createDataFrame(rows, "pair_id long, before_text string, after_text string")).select("pair_id", "added", "removed", "too_large").collect()}
    assert got == {1: (1, 1, False), 2: (19_980, 19_980, False)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=25))
def test_script_is_the_one_of_the_whole_table(a, b):
    n, m = len(a), len(b)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            common[i][j] = common[i + 1][j + 1] + 1 if a[i] == b[j] else max(common[i + 1][j], common[i][j + 1])
    want, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            want, i, j = [*want, f" {a[i]}"], i + 1, j + 1
        elif j < m and (i == n or common[i][j + 1] >= common[i + 1][j]):
            want, j = [*want, f"+{b[j]}"], j + 1
        else:
            want, i = [*want, f"-{a[i]}"], i + 1
    assert diff.script(a, b) == want
    for common in (1, 10**9):  # masks made each time, masks kept
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(diff, "COMMON", common)
            assert diff.script(a, b) == want


def test_a_pair_of_thirty_thousand_lines_is_diffed_in_seconds():
    rng = random.Random(2)
    a = [str(rng.randrange(10_000)) if rng.random() < 0.7 else "" for _ in range(30_000)]
    b = [x if rng.random() < 0.9 else str(rng.random()) for x in a if rng.random() < 0.9]
    began = time.process_time()
    lines = diff.script(a, b)
    assert time.process_time() - began < 10
    assert [x[1:] for x in lines if x[0] in " -"] == a and [x[1:] for x in lines if x[0] in " +"] == b


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_terms_of_a_table_are_found_as_contains_finds_them(piece):
    rng = random.Random(3)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(terms, "PIECE", piece)
        for k in range(400):
            letters = "ab" if k % 2 else "abcdefé漢 "
            word = lambda sizes: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
            some = [word([1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 20, 30]).encode() for _ in range(rng.randint(1, 12))]
            texts = [(word([0, 1, 5, 20, 60, 400]) + rng.choice(some).decode() * rng.randint(0, 2)).encode() for _ in range(rng.randint(0, 6))]
            row, term = terms.find_terms(texts, some, terms.file_terms(some))
            assert list(zip(row.tolist(), term.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, x in enumerate(some) if x in t]


def test_term_table_cases(spark):
    docs = spark.createDataFrame([(1, "the token: é漢"), (2, None), (3, ""), (None, "token" * 500_000 + "END"), (1, "Token")], "doc_id long, text string")
    rows = [(1, "token"), (2, "token"), (3, None), (4, ""), (5, "漢"), (6, "nENDx"), (7, "nEND"), (8, "tokentokentokentokentoken")]
    want = sorted(((i, o, t) for i, x in [tuple(r) for r in docs.collect()] for o, t in rows if x is not None and t is not None and t in x), key=str)
    listed = spark.createDataFrame(rows, "ord int, term string")
    for budget in (terms.BUDGET, 9):
        got = terms.scan_term_table(docs, listed, budget=budget)
        assert got.columns == ["doc_id", "ord", "term"] and sorted(map(tuple, got.collect()), key=str) == want
    assert terms.scan_term_table(docs, listed.limit(0)).isEmpty() and terms.scan_term_table(docs.limit(0), listed).isEmpty()


def test_dyadic_cells_cover_a_range_once(spark):
    ranges = [(lo, hi) for lo in range(-9, 10) for hi in range(-9, 20)] + [(0, 10**12), (-(10**12), 7), (None, 3), (3, None)]
    rows = spark.createDataFrame(ranges, "lo long, hi long").select("lo", "hi", integrity.dyadic_cells(F.col("lo"), F.col("hi")).alias("cells")).collect()
    for r in rows:
        cells = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in r["cells"])
        if r["lo"] is None or r["hi"] is None or r["hi"] < r["lo"]:
            assert not cells
            continue
        assert cells[0][0] == r["lo"] and cells[-1][1] == r["hi"] + 1 and all(a[1] == b[0] for a, b in zip(cells, cells[1:]))
        assert len(cells) <= 2 * (r["hi"] - r["lo"] + 1).bit_length()


def test_fresh_manifests_of_runs_of_any_length(spark):
    rng = random.Random(4)
    start = datetime(1969, 12, 20)
    runs = [(i, i % 3, start + timedelta(seconds=rng.randrange(4_000_000)), timedelta(seconds=rng.choice([-1, -9, 0, 5, 3600, 10**6, 10**9]))) for i in range(120)]
    made = [(j, j % 3, start + timedelta(seconds=rng.randrange(5_000_000), microseconds=rng.choice([0, 1, 999_999]))) for j in range(400)] + [(500 + i, u, s + d + timedelta(seconds=2, microseconds=x)) for i, (_, u, s, d) in enumerate(runs) for x in (0, 1)]
    r = spark.createDataFrame([(i, u, s, s + d) for i, u, s, d in runs] + [(999, 1, None, start)], "run_id long, user_id long, started_at timestamp, finished_at timestamp")
    m = spark.createDataFrame(made, "manifest_id long, user_id long, generated_at timestamp")
    two = timedelta(seconds=2)
    want = sorted((i, j) for i, u, s, d in runs for j, v, t in made if u == v and s - two <= t <= s + d + two)
    for width in (1, 60):
        assert sorted(map(tuple, integrity.fresh_manifests(r, m, ["user_id"], width=width).collect())) == want


def test_images(spark):
    image = "struct<width:int,height:int,data:binary>"
    rows = [(1, (2, 1, bytes(8)), (2, 1, bytes(7) + b"\1")), (2, (2, 1, bytes(8)), (1, 2, bytes(8))), (3, (2, 1, bytes(8)), (2, 1, bytes(8)))]
    got = {r["id"]: (r["comparable"], r["differing"], r["passed"]) for r in diff.image_diff(spark.createDataFrame(rows, f"id long, before {image}, after {image}"), "id").collect()}
    assert got == {1: (True, 1, False), 2: (False, None, False), 3: (True, 0, True)}


NUMBERED = " ".join(f"{i}. 题【答案】{c}" for i, c in enumerate("BCCBCADDAD", 1))


@pytest.mark.parametrize(
    ("text", "numbered", "compact"),
    [
        (NUMBERED, ("complete", "BCCBCADDAD"), ("none", None)),
        ("第1页 BAADA CBBDD 11.（1）", ("incomplete", None), ("complete", "BAADACBBDD")),
        ("1. 甲【答案】B 1. 甲【答案】c", ("conflict", None), ("none", None)),
        ("BAADA CBBDD 略 ABCDA ABCDA", ("incomplete", None), ("conflict", None)),
        ("XBAADACBBDD", ("incomplete", None), ("none", None)),
        (None, ("incomplete", None), ("none", None)),
    ],
)
def test_keys(spark, text, numbered, compact):
    docs = spark.createDataFrame([(1, text)], "doc_id long, reference_text string")
    assert tuple(keys.numbered_keys(docs).first())[1:] == numbered
    got = keys.compact_keys(docs).first()
    assert (got["status"], got["answers"]) == compact or text is None


def test_apply_keys(spark):
    sheets = spark.createDataFrame([(1, "1-5：A\n6—10：B"), (2, "1-5：A"), (3, "x"), (4, "x")], "doc_id long, text string")
    refs = spark.createDataFrame([(1, "BAADA CBBDD"), (2, NUMBERED), (3, "BAADA CBBDD 略 ABCDA ABCDA")], "doc_id long, reference_text string")
    got = {r["doc_id"]: (r["status"], r["text"]) for r in keys.apply_keys(sheets, refs).collect()}
    assert got == {1: ("applied", "1—5：B、A、A、D、A\n6—10：C、B、B、D、D"), 2: ("bad_shape", "1-5：A"), 3: ("conflict", "x"), 4: ("no_key", "x")}


SCHEMA = {
    "type": "object", "required": ["id", "tags"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "kind": {"enum": ["a", "b"]}, "name": {"type": "string", "minLength": 2, "pattern": "^x"},
        "tags": {"type": "array", "items": {"$ref": "#/$defs/tag"}, "uniqueItems": True, "maxItems": 3}, "v": {"oneOf": [{"type": "string"}, {"type": "integer"}]}, "c": {"const": 7},
    },
    "$defs": {"tag": {"type": "object", "required": ["t"], "properties": {"t": {"type": "string"}}}},
}


@pytest.mark.parametrize(
    ("json", "paths"),
    [
        ('{"id": 3.0, "tags": [{"t": "q"}], "kind": "a", "name": "xy", "v": "s", "c": 7}', []),
        ('{"id": 0, "tags": []}', ["/id"]),
        ('{"tags": [{"t": 1}, {}]}', ["", "/tags/0/t", "/tags/1"]),
        ('{"id": 1, "tags": [{"t": "a"}, {"t": "a"}], "more": 1}', ["", "/tags"]),
        ('{"id": "1", "tags": 5, "kind": "c", "name": "y", "v": true, "c": 8}', ["/c", "/id", "/kind", "/name", "/name", "/tags", "/v"]),
        ("[]", [""]),
        ("{", [""]),
    ],
)
def test_contract(spark, json, paths):
    rows = contracts.check_record_contract(spark.createDataFrame([(1, json)], "k long, j string"), "k", "j", SCHEMA).collect()
    assert sorted(r["path"] for r in rows) == paths


def test_contracts_of_keys_with_marks(spark):
    import json

    keys = ["it's", 'a "b"', "q.r[0]", "w?", "' and \""]
    schema = {"required": [*keys, "", "?.", "n"], "properties": {key: {"type": "integer"} for key in keys}}
    rows = [(1, json.dumps(dict.fromkeys([*keys, "", "?.", "n"], 1))), (2, json.dumps(dict.fromkeys(keys, "x"))), (3, "{}")]
    got = contracts.check_record_contract(spark.createDataFrame(rows, "k long, j string"), "k", "j", schema).collect()
    assert sorted((r["k"], r["path"]) for r in got) == sorted([(2, "")] * 3 + [(2, f"/{key}") for key in keys] + [(3, "")] * 8)


def test_deep_contracts(spark):
    import json

    plain = {"type": "integer"}
    record = "x"
    for _ in range(11):
        plain, record = {"type": "object", "properties": {"p": plain}}, {"p": record}
    tree = {"type": "object", "properties": {"n": {"type": "integer"}, "child": {"$ref": "#"}}}
    deep = lambda n, v: {"child": deep(n - 1, v)} if n else {"n": v}
    check = lambda schema, v: [(r["path"], r["message"]) for r in contracts.check_record_contract(spark.createDataFrame([(1, json.dumps(v))], "k long, j string"), "k", "j", schema).collect()]
    assert check(plain, record) == [("/p" * 11, "is of type string, not integer")]
    rows = [(0, json.dumps(deep(8, 1))), (1, json.dumps(deep(200, 1))), (2, json.dumps(deep(200, "x"))), (3, json.dumps(deep(9, "x")))]
    got = contracts.check_record_contract(spark.createDataFrame(rows, "k long, j string"), "k", "j", tree).collect()
    assert sorted(map(tuple, got)) == [(k, "/child" * n + "/n", "is of type string, not integer") for k, n in ((2, 200), (3, 9))]


def test_recursive_contracts_equal_a_walk_of_each_record(spark):
    """Trees of several branches, references under anyOf, oneOf and not, and two that lead into each other, against a plain walk."""
    import json

    schema = {
        "$ref": "#/$defs/node",
        "$defs": {
            "node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer", "maximum": 9}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}, "other": {"anyOf": [{"$ref": "#/$defs/leaf"}, {"$ref": "#/$defs/node"}]}, "never": {"not": {"$ref": "#/$defs/node"}}}},
            "leaf": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["leaf"], "properties": {"leaf": {"$ref": "#/$defs/leaf"}, "node": {"$ref": "#/$defs/node"}}}]},
        },
    }
    rng = random.Random(5)

    def made(depth):
        v = {"v": rng.choice([1, 2, 3, 3, 4, 10, "x"])} if rng.random() < 0.95 else {}
        if depth and rng.random() < 0.8:
            v["kids"] = [made(depth - 1) for _ in range(rng.randint(0, 2))]
        if depth and rng.random() < 0.5:
            v["other"] = made(depth - 1) if rng.random() < 0.5 else leaf(depth - 1)
        if depth and rng.random() < 0.2:
            v["never"] = made(depth - 1)
        return v

    def leaf(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["s", 5])
        return {"leaf": leaf(depth - 1)} | ({"node": made(depth - 1)} if rng.random() < 0.5 else {})

    def node_problems(v, path):
        if not isinstance(v, dict):
            return [path]
        out = [] if "v" in v else [path]
        if "v" in v and (not isinstance(v["v"], int) or v["v"] > 9):
            out.append(f"{path}/v")
        for i, kid in enumerate(v.get("kids", [])):
            out += node_problems(kid, f"{path}/kids/{i}")
        if "other" in v and leaf_problems(v["other"], "") and node_problems(v["other"], ""):
            out.append(f"{path}/other")
        if "never" in v and not node_problems(v["never"], ""):
            out.append(f"{path}/never")
        return out

    def leaf_problems(v, path):
        if isinstance(v, str):
            return []
        inner = [path] if not isinstance(v, dict) or "leaf" not in v else leaf_problems(v["leaf"], path)
        if isinstance(v, dict) and "node" in v:
            inner = inner + node_problems(v["node"], path)
        return [path] if inner else []

    records = [(i, made(9)) for i in range(60)] + [(60, 5)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(61, "{"), (62, None)], "k long, j string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(contracts, "STOPS", 4)  # some rounds, on few levels
        got = sorted((r["k"], r["path"]) for r in contracts.check_record_contract(df, "k", "j", schema).collect())
    assert got == sorted([(i, p) for i, r in records for p in node_problems(r, "")] + [(61, ""), (62, "")])
    assert len({i for i, _ in got}) < 62
    with pytest.raises(ValueError, match="without going deeper"):
        contracts.check_record_contract(df, "k", "j", {"anyOf": [{"type": "string"}, {"$ref": "#"}]})


def test_recursive_contracts_without_branches_take_one_pass(spark, monkeypatch):
    """Parts in arrays and members, references to references, to the root and under plain names, on records of many levels: no table between, small expressions."""
    import json

    schema = {
        "$ref": "#/$defs/node",
        "$defs": {
            "node": {"type": "object", "required": ["v", "w"], "properties": {"v": {"type": "integer", "minimum": 2, "maximum": 9}, "kids": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/node"}}, "next": {"$ref": "#/$defs/next"}, "in": {"type": "object", "required": ["next"], "properties": {"next": {"$ref": "#/$defs/next"}}}}},
            "next": {"$ref": "#/$defs/more"},
            "more": {"type": "array", "items": {"$ref": "#"}},
        },
    }
    rng = random.Random(7)

    def made(depth):
        if rng.random() < 0.05:
            return rng.choice([None, 5, "{[{[", [], [{"v": 1}], True])
        v = {"v": rng.choice([2, 3, 3.0, 9, 1, 10, 2.5, "3", None])} | ({"w": None} if rng.random() < 0.9 else {})
        if depth:
            v |= {"kids": [made(depth - 1) for _ in range(rng.choice([0, 1, 2, 3]))]} if rng.random() < 0.6 else {}
            v |= {"next": rng.choice([[made(depth - 1)], [], None, 3])} if rng.random() < 0.5 else {}
            v |= {"in": rng.choice([{"next": [made(depth - 1)]}, {}, None, []])} if rng.random() < 0.5 else {}
        return v

    whole = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and x == int(x)

    def node(v, path):
        if not isinstance(v, dict):
            return [path]
        out = [path for k in ("v", "w") if k not in v]
        if "v" in v and not (whole(v["v"]) and 2 <= v["v"] <= 9):
            out.append(f"{path}/v")
        if len(v.get("kids", [])) > 2:
            out.append(f"{path}/kids")
        out += [p for i, kid in enumerate(v.get("kids", [])) for p in node(kid, f"{path}/kids/{i}")]
        out += more(v["next"], f"{path}/next") if "next" in v else []
        if "in" in v and not (isinstance(v["in"], dict) and "next" in v["in"]):
            out.append(f"{path}/in")
        elif "in" in v:
            out += more(v["in"]["next"], f"{path}/in/next")
        return out

    def more(v, path):
        return [p for i, x in enumerate(v) for p in node(x, f"{path}/{i}")] if isinstance(v, list) else [path]

    chain = {"v": 1, "w": 0}
    for i in range(300):
        chain = {"v": 2 + i % 9, "w": 0, "in": {"next": [chain]}}
    records = [(i, made(7)) for i in range(200)] + [(200, chain), (201, 5)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(202, "{"), (203, None)], "k long, j string")
    monkeypatch.setattr(contracts, "cut", None)
    for stops in (8, 1, 100):
        monkeypatch.setattr(contracts, "STOPS", stops)
        found = contracts.check_record_contract(df, "k", "j", schema)
        if stops == 8:
            assert found._jdf.queryExecution().optimizedPlan().toString().count("variant_get") < 200
        got = sorted((r["k"], r["path"]) for r in found.collect())
        assert got == sorted([(i, p) for i, r in records for p in node(r, "")] + [(202, ""), (203, "")])


def outcomes(spark, rows):
    return spark.createDataFrame([("blind", *r) for r in rows], "stage string, comparison_key string, tier string, outcome string")


def test_tier_evidence(spark):
    rows = [(p, t, "pass" if i < n else "fail") for p in ("p1", "p2") for t, n in (("low", 1), ("high", 3)) for i in range(4)]
    got = evaluate.tier_evidence(outcomes(spark, rows)).first()
    assert (got["status"], got["tier"], got["accuracy"], got["evaluated"]) == ("recommendation_available", "high", 0.75, 8)
    got = evaluate.tier_evidence(outcomes(spark, [("p1", "a", "pass"), ("p2", "b", "pass")])).first()
    assert (got["status"], got["comparable_groups"]) == ("insufficient_comparative_evidence", 0)
    got = evaluate.tier_evidence(outcomes(spark, [(p, t, "pass") for p in ("p1", "p2") for t in "ab"])).first()
    assert got["status"] == "no_unique_winner"


def test_integrity_mutations(spark):
    schema = "manifest_id string, path string, bytes long, sha256 string"
    good = [("m", f"f{i}", i, hashlib.sha256(bytes([i])).hexdigest()) for i in range(5)]
    assert integrity.verify_integrity(spark.createDataFrame(good, schema), spark.createDataFrame(good, schema)).isEmpty()
    for column, bad, error in ((2, 99, "bytes"), (3, "0", "sha256"), (1, "other", "missing")):
        row = list(good[2])
        row[column] = bad
        got = integrity.verify_integrity(spark.createDataFrame([*good[:2], tuple(row), *good[3:]], schema), spark.createDataFrame(good, schema)).collect()
        assert [r["error"] for r in got] == [error]


def test_reconcile_joins_unequal_branches_only(spark):
    schema = "manifest_id string, path string, bytes long, sha256 string"
    row = lambda i: (f"m{i % 2}", f"d{i % 7}/{'flat' if i % 3 else i % 50}/f{i}", i, str(i))
    state = {i: row(i) for i in range(20_000)}
    declared = dict(state)
    want = set()
    for i, (error, change) in {11: ("missing", None), 4_000: ("bytes", 2), 9_001: ("sha256", 3), 15_555: ("undeclared", None)}.items():
        want.add((*state[i][:2], error))
        if change:
            bad = list(state[i])
            bad[change] = -1 if change == 2 else "bad"
            declared[i] = tuple(bad)
        else:
            del (state if error == "missing" else declared)[i]
    e = spark.createDataFrame(list(declared.values()), schema)
    f = spark.createDataFrame(list(state.values())[::-1], schema)
    assert {tuple(r) for r in integrity.reconcile(e, f).collect()} == want
    left, right = integrity.unequal_branches(e, f)
    assert left.columns == e.columns and left.count() + right.count() < 0.03 * 40_000
    assert integrity.reconcile(e, e).isEmpty() and integrity.reconcile(e.limit(0), f.limit(0)).isEmpty()
    assert integrity.reconcile(e.limit(0), f).where("error = 'undeclared'").count() == len(state)


def test_reconcile_with_nulls(spark):
    """Null keys never meet, as in the plain join; null values break no rule; changes that a plain exclusive or would hide are found."""
    schema = "manifest_id string, path string, bytes long, sha256 string"
    e = spark.createDataFrame([(None, "a/b", 1, "x"), ("m", None, 1, "x"), ("m", "a/b", None, "x"), ("m", "c", 5, None), ("n", "t", 1, "1")], schema)
    f = spark.createDataFrame([(None, "a/b", 1, "x"), ("m", None, 1, "x"), ("m", "a/b", 1, "x"), ("m", "c", None, "5"), ("n", "t", 2, "1")], schema)
    got = sorted(map(str, (tuple(r) for r in integrity.reconcile(e, f).collect())))
    plain = integrity.verify_integrity(e, f).unionByName(integrity.undeclared_files(e, f).withColumn("error", F.lit("undeclared")))
    assert got == sorted(map(str, (tuple(r) for r in plain.collect()))) and len(got) == 5


def test_unclosed_brackets_cost_their_length(spark):
    import time

    from markwright.operators import pages

    opened = r"\[ x " * 100_000
    df = spark.createDataFrame([(1, opened), (2, r"\[a\] $b$ " + opened), (3, r"\[\] x \] \[c")], "doc_id long, text string")
    began = time.perf_counter()
    got = [tuple(r) for r in pages.math_segments(df).orderBy("doc_id", "seq").collect()]
    assert time.perf_counter() - began < 20
    assert got == [(2, 1, "display", "a"), (2, 2, "inline", "b"), (3, 1, "display", r"\] x")]


def test_receipts_of_files_larger_than_a_row(spark, tmp_path):
    """A sparse file beyond 2 GB, which no row can hold, beside small ones; names with spaces and percent signs."""
    size = (1 << 31) + 4097
    with open(tmp_path / "big one%.bin", "wb") as out:
        out.seek(size - 3)
        out.write(b"end")
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "no+thing 5%.bin").write_bytes(b"")
    # By hashlib, over blocks of zeros and the end.
    want = "34c21e78149e209b899fb78b159c0cb8f397ee809897d6f823f5f61cff945c50"
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in files.file_receipts(spark, str(tmp_path)).collect()}
    assert got == {"big one%.bin": (size, want), "small.bin": (3, hashlib.sha256(b"abc").hexdigest()), "empty.bin": (0, hashlib.sha256(b"").hexdigest()), "no+thing 5%.bin": (0, hashlib.sha256(b"").hexdigest())}
    assert {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.file_receipts(spark, str(tmp_path), "*l*.bin", whole=0).collect()} == {k: got[k][1] for k in ("small.bin",)}


def test_layers(spark):
    entries = spark.createDataFrame([("a", "x.y", "1"), ("a", "z", "1"), ("b", "x", "2"), ("c", "x.w", "3"), ("l1", "q", "4"), ("l2", "r", "5")], "profile_key string, path string, value string")
    parents = spark.createDataFrame([("b", "a", 1), ("c", "b", 1), ("l1", "l2", 1), ("l2", "l1", 1), ("c", "gone", 2)], "profile_key string, parent string, ord int")
    got = {}
    for r in rules.layered_resolve(entries, parents).collect():
        got.setdefault(r["profile_key"], {})[r["path"]] = r["value"]
    assert got["a"] == {"x.y": "1", "z": "1"}
    assert got["b"] == {"x": "2", "z": "1"}
    assert got["c"] == {"x.w": "3", "z": "1"}
    assert "#error" in got["l1"] and "#error" in got["l2"]


def test_long_chains_of_layers(spark):
    entries = spark.createDataFrame([(f"n{i}", f"k{i}", str(i)) for i in range(12)] + [("n11", "k3", "far")], "profile_key string, path string, value string")
    parents = [(f"n{i}", f"n{i + 1}", 1) for i in range(11)] + [(f"c{i}", f"c{(i + 1) % 10}", 1) for i in range(10)]
    got = {}
    for r in rules.layered_resolve(entries, spark.createDataFrame(parents, "profile_key string, parent string, ord int")).collect():
        got.setdefault(r["profile_key"], {})[r["path"]] = r["value"]
    assert got["n0"] == {f"k{i}": str(i) for i in range(12)}
    assert got["n5"] == {f"k{i}": str(i) for i in range(5, 12)} | {"k3": "far"}
    assert [got[f"c{i}"] for i in range(10)] == [{"#error": f"cycle at c{i}"} for i in range(10)]


def test_stacked_diamonds_are_resolved_once_each(spark):
    n = 10
    entries, parents = [("end", "deep", "end"), ("end", "x.y", "1")], []
    for i in range(n):
        below = f"d{i + 1}" if i + 1 < n else "end"
        entries += [(f"a{i}", "side", f"a{i}"), (f"b{i}", "side", f"b{i}"), (f"d{i}", f"own{i}", "o")]
        parents += [(f"d{i}", f"a{i}", 1), (f"d{i}", f"b{i}", 2), (f"a{i}", below, 1), (f"b{i}", below, 1)]
    # Below a cycle, and a parent's object after a scalar that hid an outer one.
    entries += [("p", "x", "scalar"), ("q", "x.z", "3"), ("r", "k", "r")]
    parents += [("c1", "c2", 1), ("c2", "c1", 1), ("under", "c1", 1), ("under2", "under", 1), ("q", "p", 1), ("r", "end", 1), ("r", "q", 2)]
    got = {}
    found = rules.layered_resolve(spark.createDataFrame(entries, "profile_key string, path string, value string"), spark.createDataFrame(parents, "profile_key string, parent string, ord int"))
    for r in found.collect():
        assert r["path"] not in got.setdefault(r["profile_key"], {})
        got[r["profile_key"]][r["path"]] = r["value"]
    assert got["d0"] == {"deep": "end", "x.y": "1", "side": "b0"} | {f"own{i}": "o" for i in range(n)}
    assert got["c1"] == {"#error": "cycle at c1"} and got["under2"] == {"#error": "cycle above"} and "#error" in got["under"]
    assert got["q"] == {"x.z": "3"} and got["r"] == {"k": "r", "deep": "end", "x.y": "1", "x.z": "3"}


def test_numbers_come_from_several_ranges(spark):
    rows = [(f"r{i:03}", None if i % 5 == 0 else i % 4, "g" if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, priority int, source string").repartition(3)
    got = rules.merge_rules(df)
    want = sorted(rows, key=lambda r: (-(r[1] or 0), r[0]))
    assert [r["id"] for r in got.orderBy("place").collect()] == [r[0] for r in want] and [r["place"] for r in got.orderBy("place").collect()] == list(range(1, 401))
    by = evaluate.natural_order(df, "id", "source")
    for s in ("g", None):
        assert [r["id"] for r in by.where(F.col("source").eqNullSafe(F.lit(s))).orderBy("place").collect()] == sorted(r[0] for r in rows if r[2] == s)
    with pytest.MonkeyPatch.context() as patch:
        parts = []
        patch.setattr(order, "cut", lambda x: parts.append(x.select("__part").distinct().count()) or files.cut(x))
        rules.merge_rules(df), evaluate.natural_order(df, "id", "source")
    assert min(parts) > 2


def test_question_regions(spark):
    rows = [(1, 1, 1000, "1.", 50.0, 100.0), (1, 1, 1000, "2.", 50.0, 500.0), (1, 1, 1000, "7.", 50.0, 600.0), (1, 1, 1000, "3.", 300.0, 700.0), (1, 2, 1000, "2.", 50.0, 60.0), (1, 2, 1000, "3.", 50.0, 400.0), (1, 3, 1000, "4.", 50.0, 300.0)]
    got = pages.question_regions(spark.createDataFrame(rows, "doc_id long, page_no int, page_height int, text string, x double, y double")).collect()
    assert sorted((r["page_no"], r["question"], r["y0"], r["y1"]) for r in got) == [
        (1, 1, 76.0, 476.0), (1, 2, 476.0, 1000.0), (2, 2, 36.0, 376.0), (2, 3, 376.0, 1000.0), (3, 3, 0.0, 276.0), (3, 4, 276.0, 1000.0),
    ]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("# 答案\r\n".encode())
    (tmp_path / "sub" / "b.json").write_bytes('﻿{"kind": "x"}'.encode())
    (tmp_path / "sub" / "c.json").write_text("{")
    assert files.read_answers(spark, f"{tmp_path}/*.md").first()["text"] == "# 答案\r\n"
    docs = {r["path"][-6:]: r for r in files.read_json_documents(spark, f"{tmp_path}/sub/*.json", "kind string").collect()}
    assert docs["b.json"]["document"]["kind"] == "x" and docs["b.json"]["issue"] is None
    assert docs["c.json"]["document"] is None and docs["c.json"]["issue"]
    found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in files.file_receipts(spark, str(tmp_path)).collect()}
    assert found["c.json"] == (1, hashlib.sha256(b"{").hexdigest()) and len(found) == 3
    files.write_table(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    paths = spark.createDataFrame([("A\\.\\b//C/x",), ("./q",)], "p string").select(files.normal_path(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["a/b/c/x", "q"]


def test_long_blank_runs_cost_their_length(spark):
    import time

    from markwright.functions import text as X

    blank = " " * 200_000
    rows = [(1, f"a{blank}b{blank}"), (2, f"18.\n{blank}x"), (3, f"```md\n{blank}\nx\n```{blank}")]
    df = spark.createDataFrame(rows, "id long, text string")
    began = time.perf_counter()
    got = {r["id"]: r for r in df.select("id", X.trim_space(F.col("text")).alias("t"), X.join_question_leads(F.col("text")).alias("j"), X.normalize_answer(F.col("text")).alias("n")).collect()}
    assert time.perf_counter() - began < 10
    assert got[1]["t"] == f"a{blank}b" and got[2]["j"] == rows[1][1] and got[3]["n"] == "x"


def test_fences_come_off_only_whole(spark):
    from markwright.functions import text as X

    want = {"```md\na\n```": "a", "```\n```": "```\n```", "```\n\n```": "", "```python\na\n```": "```python\na\n```", "x\n```": "x\n```", "``` \n\n  a\nb \n```\n": "a\nb"}
    df = spark.createDataFrame([(k,) for k in want], "text string")
    assert {r[0]: r[1] for r in df.select("text", X.normalize_answer(F.col("text"))).collect()} == want


def test_fresh_manifests_agree_in_paths_and_are_complete(spark):
    runs = spark.sql("SELECT 1 AS run_id, 'p' AS pack, TIMESTAMP'2024-01-01 00:00:00' AS started_at, TIMESTAMP'2024-01-01 00:01:00' AS finished_at, 'A/x.md' AS input")
    made = spark.sql("SELECT * FROM VALUES (1, 'p', TIMESTAMP'2024-01-01 00:00:59', 'a/./X.md', true), (2, 'p', TIMESTAMP'2024-01-01 00:00:59', 'a/x.md', false), (3, 'p', TIMESTAMP'2024-01-01 00:00:59', 'b/x.md', true), (4, 'p', TIMESTAMP'2024-01-01 00:02:59', 'a/x.md', true) AS t(manifest_id, pack, generated_at, input, done)")
    assert [r["manifest_id"] for r in integrity.fresh_manifests(runs, made, ["pack"], paths=["input"], complete="done").collect()] == [1]


def test_phases_keep_their_error(spark):
    rows = spark.createDataFrame([(1, 0, "a", "completed", 5, None), (1, 1, "b", "failed", 6, "timeout")], "run_id long, ord int, phase string, status string, artifact long, error string")
    got = integrity.run_receipts(rows).first()
    assert not got["ok"] and got["phases"]["b"]["error"] == "timeout" and got["phases"]["a"]["error"] is None and got["phases"]["a"]["artifact"] is None


def test_fingerprints_sort_keys_at_every_depth(spark):
    import json

    from markwright.functions.text import fingerprint

    df = spark.sql("SELECT named_struct('z', 1, 'a', named_struct('y', array(named_struct('d', 'x', 'c', 2)), 'b', true), 'm', map('q', 1, 'k', 2)) AS p")
    got = df.select(fingerprint(F.col("p"), df.schema["p"].dataType)).first()[0]
    plain = json.dumps({"z": 1, "a": {"y": [{"d": "x", "c": 2}], "b": True}, "m": {"q": 1, "k": 2}}, sort_keys=True, separators=(",", ":"))
    assert got == "snapshot-" + hashlib.sha256(plain.encode()).hexdigest()[:16]


def test_readers_see_a_whole_version_whatever_happens_to_writers(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    files.publish(spark.range(5).selectExpr("id", "'old' v"), root)
    before = files.read_published(spark, root)
    with pytest.raises(Exception, match="(?i)overflow|stops here|raise"):
        files.publish(spark.range(100).selectExpr("if(id = 77, raise_error('stops here'), id) id", "'broken' v"), root)
    assert {r["v"] for r in files.read_published(spark, root).collect()} == {"old"} and files.read_published(spark, root).count() == 5
    files.publish(spark.range(7).selectExpr("id", "'new' v"), root)
    assert files.read_published(spark, root).count() == 7 and {r["v"] for r in files.read_published(spark, root).collect()} == {"new"}
    assert before.count() == 5  # a reader that began earlier ends well


def test_open_json_has_one_canonical_form(spark):
    import json

    rng = random.Random(6)

    def made(depth):
        kind = rng.randrange(6 if depth else 4)
        return [rng.randrange(99), "é漢\n\"", True, None, {}, []][kind] if kind < 4 else {rng.choice("zaBé_k") + str(i): made(depth - 1) for i in range(3)} if kind == 4 else [made(depth - 1) for _ in range(3)]

    def shuffled(v):
        if isinstance(v, dict):
            return {k: shuffled(v[k]) for k in rng.sample(sorted(v), len(v))}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    values = [{"top": made(6)} for _ in range(60)]
    rows = [(i, json.dumps(shuffled(v), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values) for _ in range(3)]
    got = spark.createDataFrame(rows, "k long, j string").select("k", X.canonical_json(F.col("j")).alias("c")).distinct().collect()
    assert sorted(map(tuple, got)) == [(i, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for i, v in enumerate(values)]
    odd = spark.createDataFrame([("{",), (None,), ('{"a":1,"a":2}',)], "j string").select(X.canonical_json(F.col("j")).alias("c")).collect()
    assert [r["c"] for r in odd] == [None] * 3


def test_versions_compare_by_numbers(spark):
    packs = spark.createDataFrame([("p", "8.15", "8.15")], "pack_id string, spec_version string, manifest_version string")
    snaps = spark.createDataFrame([("p", "8.9"), ("p", "8.15"), ("p", None)], "pack_id string, snapshot_version string")
    evals = spark.createDataFrame([("p", "8.9", False), ("p", "8.15", True), ("p", "8.2", True)], "pack_id string, eval_version string, eval_ok boolean")
    row = evaluate.health(packs, snaps, evals).first()
    assert row["healthy"] and row["summary"] == "ok"


def test_digit_runs_of_any_length_are_in_order(spark):
    names = ["a" + "1" + "0" * 30, "a2" + "0" * 29, "a2", "A10", "a010", "a9b", "a9a", "b", "a" + "9" * 31, "", "10", "9"]
    got = evaluate.natural_order(spark.createDataFrame([("g", n) for n in names], "source string, name string"), "name", "source").orderBy("place").collect()
    want = ["9", "10", "a2", "a9a", "a9b", "A10", "a010", "a2" + "0" * 29, "a1" + "0" * 30, "a" + "9" * 31, "b"]
    assert [r["name"] for r in got][1:] == want and got[0]["name"] == ""


def test_scratch_tables_go_away(spark):
    from pathlib import Path

    with files.scratch(spark):
        gone, stays = files.cut(spark.range(3)), files.cut(spark.range(2), keep=True)
        paths = [Path(f.inputFiles()[0].removeprefix("file://")) for f in (gone, stays)]
    assert not paths[0].exists() and paths[1].exists() and stays.count() == 2


def test_normalize_answer_cuts_by_code_points(spark):
    """Characters outside the basic plane before the heading do not shift the cut; all white space goes at both ends."""
    rows = spark.createDataFrame([("😀😀 so\r\n# 答案\r\nA😀　﻿\n",), (" \xa0plain $A、B$\t ",), ("😀",), (None,)], "text string")
    assert [r[0] for r in rows.select(X.normalize_answer(F.col("text"))).collect()] == ["# 答案\nA😀", "plain A、B", "😀", ""]


def test_fences_and_escaped_dollars(spark):
    rows = spark.createDataFrame([(r"\$a，b\$ $x$",), (r"$x\$，$ y",), ("$$x\n，$$ $y",), ("a$$b，c$",)], "text string")
    found = rows.select(F.size(lint.cjk_in_math(F.col("text"))), F.size(lint.unbalanced_dollar(F.col("text")))).collect()
    assert [tuple(r) for r in found] == [(0, 0), (1, 0), (1, 1), (0, 1)]
