import pytest
from pyspark.sql import functions as F

from markwright.functions import text as X
from markwright.operators import evaluate, lint, rules
from markwright.streaming.lint_stream import lint_stream

CLEAN = "# 参考答案\n\n1—5：A、B、C、D、A\n6—10：C、B、B、D、D\n\n18.（1）乙。\n功率为 $P=10$。\n"


def findings(spark, text, limit=24):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return sorted((r["check"], r["line_no"]) for r in lint.lint(docs, F.lit(limit), "doc_id").collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (CLEAN, []),
        ("1-5：A、B、C、D、A", [("choice_hyphen", 1)]),
        ("1–5：A B", [("choice_spacing", 1)]),
        ("1-5: A B", [("choice_hyphen", 1), ("choice_spacing", 1)]),
        ("18.\n\n（1）乙。", [("orphan_lead", 1)]),
        ("18\n　\n(2) x", [("orphan_lead", 1)]),
        ("18.\n甲\n（1）乙。", []),
        ("功率 `P=10 W`", [("backtick_math", 1)]),
        ("价 $x=1", [("unbalanced_dollar", None)]),
        (r"价 \$x=1", []),
        ("a\n$x\n、B$", [("cjk_in_math", 3)]),
        ("$a$ 、 $b，c$ $$d；e$$", [("cjk_in_math", 1), ("cjk_in_math", 1)]),
        ("x < / SCRIPT >", [("raw_html", None)]),
        ("<ſcript>", [("raw_html", None)]),
        ("汉" * 25, [("long_line", 1)]),
        ("- " + "汉" * 25, []),
        ("汉" * 25 + "=", []),
        ("", []),
    ],
)
def test_goldens(spark, text, want):
    assert findings(spark, text) == want


def test_limits(spark):
    assert findings(spark, "汉" * 30, 30) == []
    assert findings(spark, "汉" * 31, 30) == [("long_line", 1)]


def test_null_text_has_no_findings(spark):
    assert findings(spark, None) == []


def test_severity_and_verdict(spark):
    docs = spark.createDataFrame([(1, "math", "1-5：A B\n<svg>"), (2, "junior", "1-5：A、B"), (3, "senior", "18.\n（1）乙"), (4, "junior", CLEAN)], "doc_id long, pack_id string, text string")
    given = spark.createDataFrame([("junior.choice-answer.compact-line", "junior", "choice", True, "hard", 1), ("senior.question-lead.same-line", "senior", "lead", True, "soft", 1)], "id string, pack_id string, check_name string, enabled boolean, severity string, priority int")
    packs = docs.select("pack_id")
    levelled = rules.apply_severity(lint.lint(docs, None, "doc_id", "pack_id"), rules.applicable_rules(given, packs))
    got = {r["doc_id"]: (r["errors"], r["warnings"], r["passed"]) for r in evaluate.verdict(levelled, docs).collect()}
    assert got == {1: (1, 0, False), 2: (1, 0, False), 3: (0, 1, True), 4: (0, 0, True)}


def test_findings_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"1-5：A B\n{'汉' * i}") for i in range(40)], "doc_id long, text string")
    a, b = (sorted(map(tuple, lint.lint(d, None, "doc_id").collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert a == b


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    docs = spark.createDataFrame([(i, "junior", "1-5：A B" if i % 2 else CLEAN) for i in range(6)], "doc_id long, pack_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    given = spark.createDataFrame([("junior.choice-answer.compact-line", "junior", "choice", True, "hard", 1)], "id string, pack_id string, check_name string, enabled boolean, severity string, priority int")
    applicable = rules.applicable_rules(given, docs.select("pack_id"))
    q = lint_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), applicable).writeStream.format("memory").queryName("lint_out").start()
    q.processAllAvailable()
    q.stop()
    batch = rules.apply_severity(lint.lint(docs, None, "doc_id", "pack_id"), applicable)
    assert sorted(map(str, spark.table("lint_out").collect())) == sorted(map(str, batch.collect()))


def one(spark, f, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(f(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("```md\r\n# 答案\r\n\r\n$P=UI$\r\n```", "# 答案\n\n$P=UI$"),
        ("so let me think\n# 物理试卷参考答案\n\n1", "# 物理试卷参考答案\n\n1"),
        ("$A、B$ 和 $A'、B'$", "A、B 和 A'、B'"),
        ("　x﻿", "x"),
        (None, ""),
    ],
)
def test_normalize(spark, text, want):
    got = one(spark, X.normalize_answer, text)
    assert got == want
    assert one(spark, X.normalize_answer, got) == want


def test_scalars(spark):
    assert one(spark, X.join_question_leads, "a\n 18．\r\n\n （一）乙\n19.\n甲") == "a\n 18． （一）乙\n19.\n甲"
    assert one(spark, X.placement_mode, "  Block WIDE! ") == "block-wide"
    assert one(spark, X.placement_mode, None) == one(spark, X.placement_mode, "--") == "inline-medium"
    assert one(spark, X.escape_html, "<a b='\"'>&amp;") == "&lt;a b=&#39;&quot;&#39;&gt;&amp;amp;"
    assert tuple(one(spark, X.title_and_body, "# T \n\n b")) == ("T", "b", None)
    assert one(spark, X.title_and_body, "b")["error"]
    assert one(spark, X.response_text, '{"output_text": 3, "output": [{"content": [{"text": "a"}, {"n": 1}, {"text": "b"}]}, {}]}') == "ab"
    assert one(spark, X.response_text, '{"choices": [{"message": {"content": "z"}}]}') == "z"
    assert one(spark, X.response_text, "not json") == ""
    assert one(spark, lambda a: X.natural_key(a) < X.natural_key(F.lit("p.page-10.png")), "p.page-9.png")
    assert one(spark, X.version_key, "spec-v8.15.md") == [8, 15]
