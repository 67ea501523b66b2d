"""The registered queries of the library's own operators, and for each that SQL can express the oracle.

Each query runs over whole tables. Oracles are DuckDB SQL; they start from the same views.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.functions import chars as C
from markwright.functions import text as X
from markwright.operators import contracts, diff, evaluate, integrity, keys, lint, pages, rules, terms
from markwright.plans.views import ctes, diff_pairs, view
from markwright.sources.files import file_receipts, normal_path, publish, read_answers, read_json_documents, read_published, shared_dir, table, text_receipts, write_files

#: Documents of one file.
SHELF = 25
SHELVES = f"SELECT doc_id // {SHELF} AS shelf, string_agg(text || chr(10), '' ORDER BY doc_id) AS text, count(*) AS n, min(doc_id) AS least FROM documents GROUP BY 1"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _shelves(spark: SparkSession, d: str) -> str:
    """Documents as text files, so many to a file; its folder."""
    root = _folder(spark, "shelves")
    write_files(table(spark, d, "documents").withColumn("shelf", F.floor(F.col("doc_id") / SHELF)), root, "shelf", "doc_id", "text")
    return root


def _shelf(path: str) -> F.Column:
    return F.regexp_extract(path, r"shelf=(\d+)/", 1).cast("long").alias("shelf")


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
S = C.S

LINES = "lines AS (SELECT doc_id, pack_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, pack_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM answer_md))"
OPTIONS = C.OPTION_LIST.replace("'", "''")
TRIMMED = f"regexp_replace(line, '^{S}+|{S}+$', '', 'g')"
MASKED = r"replace(text, '\$', chr(1))"
FENCES = rf"regexp_extract_all({MASKED}, '(?s)\$\$.*?\$\$|\$.*?\$')"
NOT_PLAIN = " OR ".join(f"starts_with(t, '{p}')" for p in C.NOT_PLAIN_START)
#: (check, doc_id, pack_id, line_no) of every finding, from lines and answer_md. cjk_in_math without its line.
FINDINGS = rf"""
head AS (SELECT doc_id, pack_id, line_no, line, {TRIMMED} AS t FROM lines),
solid AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM head WHERE t <> ''),
findings AS (
  SELECT 'choice_hyphen' AS "check", doc_id, pack_id, line_no FROM head WHERE regexp_matches(t, '^{C.CHOICE_HYPHEN}')
  UNION ALL SELECT 'choice_spacing', doc_id, pack_id, line_no FROM head WHERE regexp_matches(t, '^{C.CHOICE_HEAD}') AND regexp_matches(regexp_replace(t, '^{C.CHOICE_HEAD}{S}*', ''), '{C.CHOICE_GAP}')
  UNION ALL SELECT 'orphan_lead', doc_id, pack_id, line_no FROM solid WHERE regexp_matches(line, '^{C.LEAD_ONLY}$') AND regexp_matches(next_line, '^{C.SUB_QUESTION}')
  UNION ALL SELECT 'backtick_math', doc_id, pack_id, line_no FROM head WHERE regexp_matches(line, '{C.BACKTICK_MATH}')
  UNION ALL SELECT 'unbalanced_dollar', doc_id, pack_id, NULL FROM answer_md WHERE (len({MASKED}) - len(replace({MASKED}, '$', ''))) % 2 = 1
  UNION ALL SELECT 'cjk_in_math', doc_id, pack_id, NULL FROM (SELECT doc_id, pack_id, unnest({FENCES}) AS f FROM answer_md) WHERE regexp_matches(f, '{C.CJK_MARK}')
  UNION ALL SELECT 'raw_html', doc_id, pack_id, NULL FROM answer_md WHERE regexp_matches(text, '(?i){C.RAW_HTML}')
  UNION ALL SELECT 'long_line', doc_id, pack_id, line_no FROM head WHERE t <> '' AND NOT ({NOT_PLAIN} OR contains(t, '$$') OR regexp_matches(t, '[=\\]')) AND len(regexp_extract_all(line, '{C.CJK}')) > {C.DEFAULT_LINE_LIMIT})"""
APPLICABLE = """
wanted AS (SELECT p AS pack_id, c.check_name, c.ord, CASE c.kind WHEN 'p' THEN p || c.name ELSE c.name END AS id
  FROM (SELECT unnest(['junior', 'senior', 'math']) AS p), (VALUES ('choice', 0, '.choice-answer.compact-line', 'p'), ('lead', 0, '.question-lead.same-line', 'p'), ('math', 0, 'rendering.true-latex', 'x'), ('math', 1, '.math.true-latex', 'p')) c(check_name, ord, name, kind)),
applicable AS (SELECT pack_id, check_name, id, severity FROM (SELECT w.pack_id, w.check_name, w.id, r.severity, row_number() OVER (PARTITION BY w.pack_id, w.check_name ORDER BY ord) AS n FROM wanted w JOIN rules_lit r ON w.id = r.id WHERE r.enabled) WHERE n = 1)"""
RULED = """
ruled AS (SELECT f.*, a.id AS rule_id, CASE WHEN a.severity = 'hard' THEN 'error' ELSE 'warning' END AS level FROM findings f JOIN applicable a ON f.pack_id = a.pack_id
    AND a.check_name = CASE WHEN f."check" LIKE 'choice%' THEN 'choice' WHEN f."check" = 'orphan_lead' THEN 'lead' WHEN f."check" IN ('backtick_math', 'unbalanced_dollar', 'cjk_in_math') THEN 'math' END
  UNION ALL SELECT f.*, NULL, CASE WHEN f."check" = 'raw_html' THEN 'error' ELSE 'warning' END FROM findings f WHERE f."check" IN ('raw_html', 'long_line'))"""


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "answer_md")


def _lint(name: str, check: str, found: Callable, oracle_columns: str = "doc_id, line_no::INT AS line_no") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _answers(spark, d).withColumn("lines", X.split_lines(F.col("text")))
        return lint.explode_findings(docs, found().cast(lint.FINDING), "doc_id").select("doc_id", "line_no")

    QUERIES[name] = run
    ORACLES[name] = f"{ctes('answer_md')}, {LINES}, {FINDINGS} SELECT {oracle_columns} FROM findings WHERE \"check\" = '{check}'"


# Sources
@query("s04_text_receipts", "SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return text_receipts(table(spark, d, "documents"), "doc_id", "text")


# Lint
@query("l06_to_lines", f"{ctes('answer_md')}, {LINES} SELECT doc_id, line_no::INT AS line_no, line FROM lines")
def _(spark, d):
    return lint.to_lines(_answers(spark, d))


_lint("l07_choice_hyphen", "choice_hyphen", lambda: lint.choice_hyphen(F.col("lines")))
_lint("l08_choice_spacing", "choice_spacing", lambda: lint.choice_spacing(F.col("lines")))
_lint("l09_orphan_lead", "orphan_lead", lambda: lint.orphan_lead(F.col("lines")))
_lint("l10_backtick_math", "backtick_math", lambda: lint.backtick_math(F.col("lines")))
_lint("l11_unbalanced_dollar", "unbalanced_dollar", lambda: lint.unbalanced_dollar(F.col("text")))
_lint("l14_long_line", "long_line", lambda: lint.long_lines(F.col("lines"), F.lit(C.DEFAULT_LINE_LIMIT)))


@query("l12_cjk_in_math", f"{ctes('answer_md')}, {LINES}, {FINDINGS} SELECT doc_id, count(*)::BIGINT AS n FROM findings WHERE \"check\" = 'cjk_in_math' GROUP BY doc_id")
def _(spark, d):
    return lint.explode_findings(_answers(spark, d), lint.cjk_in_math(F.col("text")), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("l13_raw_html", f"SELECT page_id, regexp_extract(html, '(?i){C.RAW_HTML}') AS tag FROM pages WHERE regexp_matches(html, '(?i){C.RAW_HTML}')")
def _(spark, d):
    return lint.explode_findings(table(spark, d, "pages"), lint.raw_html(F.col("html")), "page_id").select("page_id", F.col("detail").alias("tag"))


@query("l15_resolve_line_limit", "SELECT doc_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN 30 END, CASE WHEN doc_id % 5 = 0 THEN 28 END, CASE WHEN doc_id % 3 = 0 THEN 26 END, CASE WHEN doc_id % 2 = 0 THEN 25 END, 24)::INT AS line_limit FROM documents")
def _(spark, d):
    places = [F.when(F.col("doc_id") % m == 0, v) for m, v in ((7, 30), (5, 28), (3, 26), (2, 25))]
    return table(spark, d, "documents").select("doc_id", lint.resolve_line_limit(*places).alias("line_limit"))


TERMS = ["password", "token", "Licensed", "Apache", "@mail", "$$$", "stupid"]


@query("l16_scan_terms", f"SELECT doc_id, ord::INT AS ord, term FROM documents JOIN (SELECT unnest(range(1, {len(TERMS) + 1})) AS ord, unnest({TERMS}) AS term) t ON contains(text, term)")
def _(spark, d):
    return lint.scan_terms(table(spark, d, "documents"), TERMS)


#: Parts of the benchmark's texts, of six lengths, from every place: tens of thousands of terms, more with every item.
TERM_LIST = "SELECT item_id * 1000000 + s * 100 + l AS ord, substr(text, CAST(s AS INT), CAST(l AS INT)) AS term FROM ({places}) p WHERE length(substr(text, CAST(s AS INT), CAST(l AS INT))) = l"


@query(
    "l16_scan_term_table",
    f"""WITH lengths AS (SELECT unnest([12, 14, 17, 20, 24, 32]) AS l),
terms AS ({TERM_LIST.format(places='SELECT item_id, text, unnest(range(1, length(text) + 1)) AS s, l FROM benchmark, lengths')}),
parts AS (SELECT doc_id, substr(text, 1 + 1000 * k, 1040) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text) // 1000 + 1)) AS k FROM documents)),
grams AS (SELECT doc_id, part, j, substr(part, j, 12) AS gram FROM (SELECT doc_id, part, unnest(range(1, length(part) + 1)) AS j FROM parts))
SELECT DISTINCT doc_id, ord, term FROM grams JOIN terms ON gram = substr(term, 1, 12) AND substr(part, j, length(term)) = term""",
)
def _(spark, d):
    items = table(spark, d, "benchmark").selectExpr("item_id", "text", "explode(sequence(1, length(text))) AS s").selectExpr("*", "explode(array(12, 14, 17, 20, 24, 32)) AS l")
    return terms.scan_term_table(table(spark, d, "documents"), spark.sql(TERM_LIST.format(places="SELECT * FROM {items}"), items=items))


@query("l17_require_marker", "SELECT doc_id FROM documents WHERE NOT contains(text, 'Licensed under')")
def _(spark, d):
    return lint.require_marker(table(spark, d, "documents"), "Licensed under")


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "manifests")
    return m.select(
        "manifest_id", "kind", "subject_pack", "snapshot_id", "snapshot_path", "profile", "input", "output",
        F.struct(F.col("s_id").alias("id"), F.col("s_version").alias("version"), F.col("s_profile").alias("profile")).alias("snapshot"),
        F.struct("toolchain_passed", "delivery_complete", F.lit(False).alias("review_artifact_ready")).alias("status"),
        F.struct(F.col("ocr_status").alias("status"), F.col("ocr_provider").alias("provider"), F.lit("1").alias("version"), F.lit("zh").alias("language"), F.col("ocr_error").alias("error"), "page_count").alias("ocr"),
        F.struct(F.lit(None).cast("string").alias("output_dir"), F.lit(None).cast("string").alias("manifest_path")).alias("review"),
    )


_FIELD_RULES = [
    ("kind", "kind <> 'delivery-manifest'"), ("snapshot_id", "snapshot_id <> s_id"), ("profile", "profile <> s_profile"), ("subject_pack", "trim(subject_pack) = ''"), ("snapshot.version", "s_version = ''"),
    ("input", "NOT suffix(lower(input), '.md')"), ("status.delivery_complete without output", "delivery_complete AND NOT EXISTS (SELECT 1 FROM outs WHERE outs.path = output)"), ("ocr.status", "ocr_status = 'unknown'"),
    ("ocr.provider missing", "ocr_status IN ('ok', 'failed', 'requested') AND ocr_provider IS NULL"), ("ocr.provider not wanted", "ocr_status = 'not-requested' AND ocr_provider IS NOT NULL"),
    ("ocr.version not wanted", "ocr_status = 'not-requested'"), ("ocr.language not wanted", "ocr_status = 'not-requested'"), ("ocr.error", "ocr_status = 'failed' AND ocr_error IS NULL"),
    ("ocr.page_count", "ocr_status <> 'unknown' AND page_count < 0"), ("status.toolchain_passed", "toolchain_passed IS NULL"),
]


@query("l18_check_manifest_fields", ctes("manifests") + ", outs AS (SELECT concat('f/', doc_id, '.pdf') AS path FROM documents WHERE doc_id % 6 <> 0) " + " UNION ALL ".join(f"SELECT manifest_id, '{e}' AS error FROM manifests WHERE {w}" for e, w in _FIELD_RULES))
def _(spark, d):
    outs = table(spark, d, "documents").where("doc_id % 6 <> 0").select(F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.lit(False).alias("is_dir"))
    return integrity.check_manifest_fields(_manifests(spark, d), outs)


_REVIEWED = "doc_id % 3 = 0 AND doc_id % 59 <> 0"
_REVIEW_RULES = [
    ("review", "doc_id % 59 = 0"), ("status.review_artifact_ready without directory", f"{_REVIEWED} AND doc_id % 4 = 0"), ("status.review_artifact_ready without manifest", f"{_REVIEWED} AND doc_id % 5 = 0"),
    ("status.review_artifact_ready", "doc_id % 61 = 0 AND doc_id % 3 <> 0"),
]


@query(
    "l18_review_artifacts",
    ctes("manifests") + ", outs AS (SELECT concat('f/', doc_id, '.pdf') AS path FROM documents WHERE doc_id % 6 <> 0) " + " UNION ALL ".join([f"SELECT manifest_id, '{e}' AS error FROM manifests WHERE {w}" for e, w in _FIELD_RULES] + [f"SELECT doc_id, '{e}' FROM documents WHERE {w}" for e, w in _REVIEW_RULES]),
)
def _(spark, d):
    """Manifests of which some kept review artifacts, in folders of which some are gone, or have lost their manifest."""
    i = F.col("manifest_id")
    folder = F.concat(F.lit("r/"), i.cast("string"))
    ready = F.when(i % 3 == 0, True).when(i % 61 != 0, False)
    kept = _manifests(spark, d).withColumns({
        "status": F.col("status").withField("review_artifact_ready", ready),
        "review": F.when(i % 59 != 0, F.struct(folder.alias("output_dir"), F.concat(folder, F.lit("/manifest.json")).alias("manifest_path"))),
    })
    docs = table(spark, d, "documents")
    named = lambda where, head, tail, is_dir: docs.where(where).select(F.concat(F.lit(head), F.col("doc_id").cast("string"), F.lit(tail)).alias("path"), F.lit(is_dir).alias("is_dir"))
    there = named("doc_id % 6 <> 0", "f/", ".pdf", False).union(named("doc_id % 4 <> 0", "r/", "", True)).union(named("doc_id % 5 <> 0", "r/", "/manifest.json", False))
    return integrity.check_manifest_fields(kept, there)


CONTRACT = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90, "not": {"const": 42}}}, "additionalProperties": False}


@query(
    "l19_check_record_contract",
    "SELECT event_id, '/k' AS path, CASE WHEN k < 5 THEN 'below 5' WHEN k > 90 THEN 'above 90' ELSE 'matches the forbidden schema' END AS message FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE k < 5 OR k > 90 OR k = 42",
)
def _(spark, d):
    return contracts.check_record_contract(table(spark, d, "events"), "event_id", "props", CONTRACT)


#: A record may hold a record of its kind, as deep as it likes.
CHAIN = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 90}, "child": {"$ref": "#"}}}
CHAINS = """SELECT event_id, concat(repeat('{{"k":7,"child":', CAST(event_id % 20 AS INT)), props, repeat('}}', CAST(event_id % 20 AS INT))) AS record FROM {events}"""


@query(
    "l19_recursive_contract",
    "SELECT event_id, repeat('/child', (event_id % 20)::INT) || '/k' AS path, CASE WHEN k < 5 THEN 'below 5' ELSE 'above 90' END AS message FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) WHERE k < 5 OR k > 90",
)
def _(spark, d):
    # Judging costs far more than the rows, which a file may keep in one task: they are dealt before the chains are made.
    events = table(spark, d, "events").select("event_id", "props").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return contracts.check_record_contract(spark.sql(CHAINS, events=events), "event_id", "record", CHAIN)


@query(
    "l20_check_baseline",
    """WITH p AS (SELECT source, doc_id // 100 AS part, min(sha256(text)) AS sha, bool_or(quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT concat_ws('-', source, part::VARCHAR) AS id, CASE WHEN part % 17 = 3 THEN 'kind' WHEN part % 11 = 0 THEN 'comparison_key' WHEN part % 7 = 0 AND upper(sha) <> sha THEN 'authority.source_exam'
  WHEN open THEN 'blind.cases: open though run' WHEN part % 5 = 1 THEN 'blind.execution' END AS error FROM p""",
)
def _(spark, d):
    """Baselines with planted errors, one for every hundred documents of a source; stages hold the labelled outcomes."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    case = F.struct(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality").isNull(), "not_evaluated").when(F.col("quality") == 1, "pass").otherwise("fail").alias("value"))
    per = docs.groupBy("source", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.map_from_entries(F.collect_list(case)).alias("cases"), F.min(F.sha2("text", 256)).alias("sha"))
    binding = F.struct(F.lit("a/b.pdf").alias("path"), F.when(F.col("part") % 7 == 0, F.upper("sha")).otherwise(F.col("sha")).alias("sha256"))
    tier = F.struct(F.when(F.col("part") % 5 == 1, "other").otherwise(evaluate.MODELS[0]).alias("model"), F.lit("high").alias("reasoning_effort"))
    open_cases = F.transform_values("cases", lambda k, v: F.lit("not_evaluated"))
    all_passed = F.transform_values("cases", lambda k, v: F.lit("pass"))
    stage = lambda status, cases, done: F.struct(F.lit(status).alias("status"), F.when(F.lit(done), tier).alias("execution"), F.when(F.lit(done), binding).alias("artifact"), cases.alias("cases"))
    stages = F.create_map(F.lit("blind"), stage("evaluated", F.col("cases"), True), F.lit("visualAudit"), stage("not_run", open_cases, False), F.lit("referenceReview"), stage("evaluated", all_passed, True))
    baselines = per.select(
        F.when(F.col("part") % 17 == 3, "other").otherwise(evaluate.BASELINE_KIND).alias("kind"), F.lit(evaluate.BASELINE_VERSION).alias("schema_version"), F.concat_ws("-", "source", F.col("part").cast("string")).alias("id"), F.lit(2024).alias("year"), F.lit("physics").alias("subject_pack"), F.when(F.col("part") % 11 != 0, F.col("source")).alias("comparison_key"),
        F.col("ids").alias("target_questions"), F.struct(binding.alias("source_exam"), binding.alias("reference_answer")).alias("authority"), stages.alias("stages"), F.lit("e").alias("evidence_ref"), F.lit(True).alias("teacher_accepted"),
    )
    return evaluate.check_baseline(baselines)


# Rules and severity
@query("r21_applicable_rules", f"{ctes('answer_md', 'rules_lit')}, {APPLICABLE} SELECT a.* FROM applicable a WHERE pack_id IN (SELECT pack_id FROM answer_md)")
def _(spark, d):
    return rules.applicable_rules(view(spark, d, "rules_lit"), _answers(spark, d))


def _levelled(spark: SparkSession, d: str) -> DataFrame:
    docs = _answers(spark, d)
    findings = lint.lint(docs, None, "doc_id", "pack_id").select("doc_id", "pack_id", "check", "line_no")
    packs = spark.createDataFrame([("junior",), ("senior",), ("math",)], "pack_id string")
    return rules.apply_severity(findings, rules.applicable_rules(view(spark, d, "rules_lit"), packs))


W1 = f"{ctes('answer_md', 'rules_lit')}, {LINES}, {FINDINGS}, {APPLICABLE}, {RULED}"
VERDICT = """SELECT d.doc_id, count(*) FILTER (level = 'error')::BIGINT AS errors, count(*) FILTER (level = 'warning')::BIGINT AS warnings, count(*) FILTER (level = 'error') = 0 AS passed
  FROM answer_md d LEFT JOIN ruled r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""


@query("r23_apply_severity", f'{W1} SELECT "check", doc_id, level, rule_id, count(*)::BIGINT AS n FROM ruled GROUP BY ALL')
def _(spark, d):
    return _levelled(spark, d).groupBy("check", "doc_id", "level", "rule_id").agg(F.count("*").alias("n"))


@query("w1_lint_verdict", f"{W1} {VERDICT}")
def _(spark, d):
    return evaluate.verdict(_levelled(spark, d), table(spark, d, "documents"))


@query(
    "e32_score_cases",
    f"""{W1}, verdicts AS ({VERDICT}), cased AS (SELECT d.source AS suite, d.doc_id AS case_id, p.profile, v.passed = (d.doc_id % 2 = 0) AND v.warnings <= coalesce(CASE WHEN p.profile = 'compact' THEN 0 END, 1000000) AS ok
  FROM verdicts v JOIN documents d USING (doc_id), (SELECT unnest(['classroom', 'compact']) AS profile) p)
SELECT suite, case_id, profile, bool_and(ok) AS ok FROM cased GROUP BY ROLLUP (suite, case_id, profile) HAVING suite IS NOT NULL""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    profiles = F.explode(F.array(F.lit("classroom"), F.lit("compact"))).alias("profile")
    none = F.lit(None).cast("boolean")
    verdicts = evaluate.verdict(_levelled(spark, d), docs).join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("suite"), F.col("doc_id").alias("case_id"), profiles, "passed", "warnings", none.alias("visual_ok"), none.alias("delivery_ok"))
    expected = docs.select(F.col("doc_id").alias("case_id"), profiles, (F.col("doc_id") % 2 == 0).alias("should_pass")).withColumn("max_warnings", F.when(F.col("profile") == "compact", 0))
    return evaluate.score_cases(verdicts, expected)


@query("e33_same_bag", "SELECT a.vec_id, list_sort(a.embedding) = list_sort(list_reverse(a.embedding)) AS same, list_sort(a.embedding) = list_sort(b.embedding) AS same_as_next FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    a, b = table(spark, d, "embeddings"), table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", X.same_bag(F.col("embedding"), F.reverse("embedding")).alias("same"), X.same_bag(F.col("embedding"), F.col("other")).alias("same_as_next"))


@query(
    "e34_score_delivery",
    """SELECT doc_id AS case_id, lang AS profile, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 11 <> 0 AS ok FROM documents""",
)
def _(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i.alias("case_id"), F.col("lang").alias("profile"), "doc_id")
    made = docs.select("case_id", "profile", F.when(i % 5 != 0, "s").alias("snapshot_id"), F.array(F.lit("b"), F.lit("a")).alias("graphics"), (i % 7 != 0).alias("toolchain_passed"), F.lit(True).alias("delivery_complete"), (i % 2 == 0).alias("review_artifact_ready"), F.create_map(F.lit("status"), F.when(i % 3 == 0, "failed").otherwise("ok")).alias("ocr"))
    none = F.lit(None).cast("boolean")
    wanted = docs.select("case_id", "profile", (i % 2 == 0).alias("keep_review"), F.array(F.lit("a"), F.when(i % 11 == 0, "c").otherwise("b")).alias("expected_graphics"), none.alias("expected_toolchain_passed"), none.alias("expected_delivery_complete"), none.alias("expected_review_artifact_ready"), F.create_map(F.lit("status"), F.lit("ok")).alias("expected_ocr"))
    return evaluate.score_delivery(made, wanted)


_STAGE = ", ".join(f"""count(*) FILTER (stage = '{s}' AND outcome = 'pass')::BIGINT AS "{s}_passes", count(*) FILTER (stage = '{s}' AND outcome = 'fail')::BIGINT AS "{s}_failures",
  CASE WHEN count(*) FILTER (stage = '{s}') = 0 THEN 'absent' WHEN count(*) FILTER (stage = '{s}' AND outcome <> 'not_evaluated') = 0 THEN 'not_run' ELSE 'evaluated' END AS "{s}_status" """ for s in evaluate.STAGES)


@query("e35_stage_summary", f"{ctes('stage_outcomes')} SELECT comparison_key, {_STAGE} FROM stage_outcomes GROUP BY comparison_key")
def _(spark, d):
    return evaluate.stage_summary(view(spark, d, "stage_outcomes"))


@query(
    "e36_tier_evidence",
    f"""{ctes('stage_outcomes')}, red AS (SELECT comparison_key, tier, count(*) FILTER (outcome = 'pass') AS p, count(*) AS e FROM stage_outcomes WHERE stage = 'blind' AND outcome <> 'not_evaluated' GROUP BY ALL),
comp AS (SELECT comparison_key FROM red GROUP BY 1 HAVING count(*) >= 2),
tiers AS (SELECT tier, sum(p) / sum(e) AS accuracy, sum(e)::BIGINT AS evaluated FROM red WHERE comparison_key IN (FROM comp) GROUP BY tier HAVING count(*) >= 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, evaluated DESC, tier) AS n, count(*) OVER () AS k, count(*) FILTER (accuracy = (SELECT max(accuracy) FROM tiers)) OVER () AS best FROM tiers)
SELECT 'recommendation_available' AS status, 'blind' AS stage, (SELECT count(*) FROM comp)::BIGINT AS comparable_groups, tier, accuracy, evaluated FROM ranked WHERE n = 1 AND k >= 2 AND best = 1 AND (SELECT count(*) FROM comp) >= 2
UNION ALL SELECT CASE WHEN (SELECT count(*) FROM comp) < 2 OR (SELECT count(*) FROM tiers) < 2 THEN 'insufficient_comparative_evidence' ELSE 'no_unique_winner' END, 'blind', (SELECT count(*) FROM comp)::BIGINT, NULL, NULL, NULL
  WHERE NOT EXISTS (SELECT 1 FROM ranked WHERE n = 1 AND k >= 2 AND best = 1 AND (SELECT count(*) FROM comp) >= 2)""",
)
def _(spark, d):
    return evaluate.tier_evidence(view(spark, d, "stage_outcomes"))


@query("e37_duplicate_keys", f"{ctes('doc_rules')} SELECT id, count(*)::BIGINT AS n FROM doc_rules GROUP BY id HAVING count(*) > 1")
def _(spark, d):
    return rules.duplicate_keys(view(spark, d, "doc_rules"), "id")


_RECEIPT = """'{{"path":"{role}/' || doc_id || '","bytes":' || strlen(text) || ',"sha256":"' || sha256(text) || '"}}'"""


@query(
    "e38_build_manifests",
    f"""{ctes('answer_md')} SELECT d.doc_id AS run_id, d.doc_id % 3 <> 0 AS complete, (d.doc_id % 29 = 0)::INT AS graphics,
  '{{"schemaVersion":"1.1","kind":"delivery-manifest","snapshotId":"s' || d.doc_id % 10 || '","snapshot":{{"id":"s' || d.doc_id % 10 || '","version":"8.2","profile":"classroom"}},"subjectPack":"' || d.lang || '","profile":"classroom","ocr":'
  || CASE WHEN d.doc_id % 4 = 0 THEN '{{"status":"ok","provider":"engine","version":"1","language":"' || d.lang || '","pageCount":' || d.doc_id % 9 || '}}' ELSE '{{"status":"not-requested"}}' END
  || ',"graphics":{{"items":[' || CASE WHEN d.doc_id % 29 = 0 THEN '{{"placement_path":"g' || d.doc_id % 10 || '.json"}}' ELSE '' END || ']}},"integrity":{{"algorithm":"sha256","input":' || {_RECEIPT.format(role='input')} || ',"output":' || {_RECEIPT.format(role='output')}
  || ',"snapshot":' || {_RECEIPT.format(role='snapshot')} || ',"reviewFiles":[' || {_RECEIPT.format(role='review')} || ']}},"status":{{"toolchainPassed":' || (d.doc_id % 3 <> 0) || ',"deliveryComplete":' || (d.doc_id % 3 <> 0) || ',"reviewArtifactReady":' || (d.doc_id % 2 = 0) || '}}}}' AS json
FROM documents d""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    ocr = F.struct(F.lit("ok").alias("status"), F.lit("engine").alias("provider"), F.lit("1").alias("version"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("error"), (F.col("doc_id") % 9).cast("int").alias("page_count"))
    asked, version = F.when(F.col("doc_id") % 4 == 0, ocr).alias("ocr"), F.lit("8.2").alias("snapshot_version")
    runs = docs.select(F.col("doc_id").alias("run_id"), F.col("lang").alias("pack"), F.lit("classroom").alias("profile"), (F.col("doc_id") % 3 != 0).alias("toolchain_passed"), (F.col("doc_id") % 2 == 0).alias("keep_review"), asked, F.concat(F.lit("s"), (F.col("doc_id") % 10).cast("string")).alias("snapshot_id"), version)
    roles = F.explode(F.array(*map(F.lit, ("input", "output", "snapshot", "review")))).alias("role")
    files = docs.select(F.col("doc_id").alias("run_id"), roles, "doc_id", X.text_receipt(F.col("text")).alias("r")).select("run_id", "role", F.concat_ws("/", "role", F.col("doc_id").cast("string")).alias("path"), "r.bytes", "r.sha256")
    refs = integrity.graphic_refs(_answers(spark, d)).select(F.col("doc_id").alias("run_id"), "ord", F.col("path").alias("placement_path"))
    return integrity.build_manifests(runs, files, refs).select("run_id", F.col("manifest.status.deliveryComplete").alias("complete"), F.size("manifest.graphics.items").alias("graphics"), "json")


@query(
    "e39_run_receipts",
    f"""{ctes('phase_rows')}, last AS (SELECT run_id, phase, max((ord, status, artifact)) AS p FROM phase_rows GROUP BY ALL), f AS (SELECT run_id, phase, p[2] AS status, p[3] AS artifact FROM last)
SELECT run_id, NOT bool_or(status = 'failed') AS ok, count(*)::INT AS n_phases, string_agg(phase || '=' || status, ',' ORDER BY phase) AS statuses, CASE WHEN NOT bool_or(status = 'failed') THEN coalesce(sum(artifact) FILTER (status = 'completed'), 0)::BIGINT ELSE 0 END AS artifact_sum FROM f GROUP BY run_id""",
)
def _(spark, d):
    done = integrity.run_receipts(view(spark, d, "phase_rows"))
    listed = F.array_sort(F.transform(F.map_entries("phases"), lambda e: F.concat_ws("=", e["key"], e["value"]["status"])))
    total = F.aggregate(F.map_values("phases"), F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p["artifact"], F.lit(0)))
    return done.select("run_id", "ok", "n_phases", F.array_join(listed, ",").alias("statuses"), total.alias("artifact_sum"))


@query(
    "e40_health",
    """SELECT 'p' || doc_id AS pack_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS healthy, concat_ws('; ', CASE WHEN doc_id % 3 = 0 THEN 'specification and manifest versions differ' END, CASE WHEN doc_id % 5 = 0 THEN 'snapshot is stale' END, CASE WHEN doc_id % 7 = 0 THEN 'evaluation failed' END) AS issues FROM documents""",
)
def _(spark, d):
    i, name = F.col("doc_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("pack_id")
    docs = table(spark, d, "documents")
    packs = docs.select(name, F.when(i % 3 == 0, "8.9").otherwise("8.15").alias("spec_version"), F.lit("8.15").alias("manifest_version"))
    snaps = docs.select(name, F.explode(F.when(i % 5 == 0, F.array(F.lit("8.9"), F.lit("8.2"))).otherwise(F.array(F.lit("8.9"), F.lit("8.15"), F.lit("8.2")))).alias("snapshot_version"))
    evals = docs.select(name, F.explode(F.array(F.lit("8.9"), F.lit("8.15"))).alias("eval_version"), (i % 7 != 0).alias("eval_ok"))
    return evaluate.health(packs, snaps, evals).select("pack_id", "healthy", F.array_join("issues", "; ").alias("issues"))


# Deliveries
KEYS = "USING (manifest_id, path)"
FILES = ctes("file_entries", "file_state")


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "file_entries"), view(spark, d, "file_state")


@query(
    "d24_verify_integrity",
    f"{FILES} SELECT manifest_id, path, 'missing' AS error FROM file_entries e ANTI JOIN file_state s {KEYS} UNION ALL SELECT manifest_id, path, 'bytes' FROM file_entries e JOIN file_state s {KEYS} WHERE e.bytes <> s.bytes UNION ALL SELECT manifest_id, path, 'sha256' FROM file_entries e JOIN file_state s {KEYS} WHERE e.sha256 <> s.sha256",
)
def _(spark, d):
    return integrity.verify_integrity(*_files(spark, d))


@query("d25_undeclared_files", f"{FILES} SELECT manifest_id, path FROM file_state ANTI JOIN file_entries {KEYS}")
def _(spark, d):
    return integrity.undeclared_files(*_files(spark, d))


@query("d26_stale_entries", f"{FILES} SELECT manifest_id, path FROM file_entries ANTI JOIN file_state {KEYS}")
def _(spark, d):
    return integrity.stale_entries(*_files(spark, d))


@query("d48_file_set_delta", f"{FILES} SELECT manifest_id, path, 'bound' AS side FROM file_entries ANTI JOIN file_state {KEYS} UNION ALL SELECT manifest_id, path, 'actual' FROM file_state ANTI JOIN file_entries {KEYS}")
def _(spark, d):
    return integrity.file_set_delta(*_files(spark, d))


@query(
    "d26_reconcile",
    f"{FILES} SELECT manifest_id, path, 'missing' AS error FROM file_entries e ANTI JOIN file_state s {KEYS} UNION ALL SELECT manifest_id, path, 'bytes' FROM file_entries e JOIN file_state s {KEYS} WHERE e.bytes <> s.bytes UNION ALL SELECT manifest_id, path, 'sha256' FROM file_entries e JOIN file_state s {KEYS} WHERE e.sha256 <> s.sha256 UNION ALL SELECT manifest_id, path, 'undeclared' FROM file_state ANTI JOIN file_entries {KEYS}",
)
def _(spark, d):
    """All four reports at once, from the branches whose digests differ; one file in ten differs here, so that leaves are small."""
    return integrity.reconcile(*_files(spark, d), leaf=4)


@query(
    "d22_snapshot_consistency",
    f"""{ctes('manifests')}, snaps AS (SELECT DISTINCT concat('snap/', doc_id % 10, '.json') AS path, concat('s', doc_id % 10) AS snapshot_id FROM documents), j AS (SELECT m.*, s.path AS found, s.snapshot_id AS real_id FROM manifests m LEFT JOIN snaps s ON m.snapshot_path = s.path)
SELECT manifest_id, 'snapshot missing' AS error FROM j WHERE found IS NULL UNION ALL SELECT manifest_id, 'snapshot_id' FROM j WHERE found IS NOT NULL AND snapshot_id <> real_id UNION ALL SELECT manifest_id, 'snapshot.id' FROM j WHERE found IS NOT NULL AND s_id <> real_id
UNION ALL SELECT manifest_id, 'snapshot.version' FROM j WHERE found IS NOT NULL AND s_version <> '1.0' UNION ALL SELECT manifest_id, 'subject_pack' FROM j WHERE found IS NOT NULL AND subject_pack <> 'en'""",
)
def _(spark, d):
    n = (F.col("doc_id") % 10).cast("string")
    snaps = table(spark, d, "documents").select(F.concat(F.lit("snap/"), n, F.lit(".json")).alias("path"), F.concat(F.lit("s"), n).alias("snapshot_id"), F.lit("1.0").alias("version"), F.lit("classroom").alias("profile"), F.lit("en").alias("pack")).distinct()
    return integrity.snapshot_consistency(_manifests(spark, d), snaps)


@query("d27_path_collisions", f"{ctes('run_paths')} SELECT run_id, path FROM run_paths o WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM run_paths i WHERE i.event_type = 'view' AND i.run_id = o.run_id AND lower(i.path) = lower(o.path))")
def _(spark, d):
    paths = view(spark, d, "run_paths")
    return integrity.path_collisions(paths.where("event_type = 'view'"), paths.where("event_type = 'purchase'").select("run_id", "path"))


@query(
    "d28_match_graphics",
    f"""{ctes('answer_md')}, refs AS (SELECT doc_id AS manifest_id, 'g' || (doc_id % 10) || '.json' AS p FROM answer_md WHERE doc_id % 29 = 0)
SELECT manifest_id, 0 AS item, 'placement missing' AS error FROM refs WHERE p IN ('g8.json', 'g9.json') UNION ALL SELECT manifest_id, 0, 'kind' FROM refs WHERE p = 'g7.json' UNION ALL SELECT manifest_id, 0, 'graphic_id' FROM refs WHERE p < 'g8' AND manifest_id % 3 = 0""",
)
def _(spark, d):
    i = F.col("doc_id")
    refs = integrity.graphic_refs(_answers(spark, d)).where(F.col("path").rlike(r"\Ag\d\.json\z")).select(i.alias("manifest_id"), F.lit(0).alias("item"), F.col("path").alias("placement_path"), F.lit("x").alias("placed_graphic_id"), F.when(i % 3 == 0, "z").otherwise("y").alias("graphic_id"), *(F.lit(None).cast("string").alias(c) for c in ("artifact_id", "question_ref", "placement_mode", "preview_path")))
    n = F.col("doc_id") % 8
    placed = table(spark, d, "documents").select(F.concat(F.lit("g"), n.cast("string"), F.lit(".json")).alias("placement_path"), F.when(n == 7, "other").otherwise("placed-answer-graphic").alias("kind"), F.lit(" ").alias("placed_graphic_id"), F.lit("y").alias("graphic_id"), *(F.lit(None).cast("string").alias(c) for c in ("artifact_id", "question_ref", "placement_mode", "preview_path"))).distinct()
    return integrity.match_graphics(refs, placed)


@query(
    "d29_fresh_manifests",
    f"""{ctes('runs', 'run_manifests')} SELECT run_id, manifest_id FROM runs r JOIN run_manifests m ON r.user_id = m.user_id AND r.subject_pack = m.subject_pack AND r.profile = m.profile
  AND generated_at BETWEEN started_at - INTERVAL 2 SECOND AND finished_at + INTERVAL 2 SECOND
WHERE m.complete AND replace(r.input, '/./', '/') = replace(lower(m.input), '//', '/') AND lower(r.output) = m.output""",
)
def _(spark, d):
    """Runs from seconds to more than a year long, of which one in eight ends before it starts."""
    return integrity.fresh_manifests(view(spark, d, "runs"), view(spark, d, "run_manifests"), ["user_id", "subject_pack", "profile"], width=1, paths=["input", "output"], complete="complete")


@query("d30_drift", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'different' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 0")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    stored = docs.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n"))))
    return integrity.drift(docs, stored, "doc_id")


@query("d49_graphic_refs", f"{ctes('answer_md')} SELECT doc_id, ord::INT - 1 AS ord, path FROM (SELECT doc_id, unnest(p) AS path, unnest(range(1, len(p) + 1)) AS ord FROM (SELECT doc_id, regexp_extract_all(text, '{C.GRAPHIC_MARK}', 1) AS p FROM answer_md))")
def _(spark, d):
    return integrity.graphic_refs(_answers(spark, d))


@query("d_normal_path", "SELECT page_id, lower(regexp_replace(url, '(/\\.?)+/', '/', 'g')) AS path FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", normal_path(F.col("url")).alias("path"))


# Routing, versions, order
ORDER = "CASE WHEN role = 'primary' THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(role, '^fallback_([0-9]+)$', 1) AS INT), 999) END"


@query("v41_route", f"{ctes('attempts')} SELECT request_id, first(role ORDER BY {ORDER}) AS selected_role, string_agg(role, ',' ORDER BY {ORDER}) AS ordered_roles FROM attempts WHERE role LIKE 'fallback%' GROUP BY 1")
def _(spark, d):
    return evaluate.route(view(spark, d, "attempts"), "fallback").withColumn("ordered_roles", F.array_join("ordered_roles", ","))


@query(
    "v42_failover_outcome",
    f"""{ctes('attempts')}, a AS (SELECT *, {ORDER} AS o, ok OR NOT (status IS NULL OR status IN {C.RETRYABLE}) AS ends FROM attempts), t AS (SELECT request_id, min(o) FILTER (ends) AS stop, max(o) AS last FROM a GROUP BY 1)
SELECT a.request_id, any_value(ok) FILTER (o = coalesce(stop, last)) AND any_value(stop) IS NOT NULL AS ok, any_value(role) FILTER (o = coalesce(stop, last)) AS provider, count(*) FILTER (o <= coalesce(stop, last))::BIGINT AS n_attempts,
  CASE WHEN any_value(stop) IS NULL THEN '{C.ALL_RETRYABLE_FAILED}' WHEN NOT any_value(ok) FILTER (o = stop) THEN 'status ' || any_value(status) FILTER (o = stop) END AS error FROM a JOIN t USING (request_id) GROUP BY a.request_id""",
)
def _(spark, d):
    return evaluate.failover_outcome(view(spark, d, "attempts"))


@query("v43_latest_version", f"{ctes('file_names')}, v AS (SELECT *, list_transform(string_split(regexp_extract(file_name, 'v([0-9]+[.][0-9]+)', 1), '.'), lambda x: x::INT) AS k FROM file_names) SELECT source, array_to_string(max(k), '.') AS version, max_by(file_name, k) AS file_name FROM v GROUP BY source")
def _(spark, d):
    return evaluate.latest_version(view(spark, d, "file_names"), "source", "file_name")


@query("v44_rank_packs", f"{ctes('doc_packs')} SELECT source, pack_id, active, row_number() OVER (PARTITION BY source ORDER BY active DESC, pack_id = 'p7' DESC, lower(pack_id), pack_id)::INT AS place FROM doc_packs")
def _(spark, d):
    return evaluate.rank_packs(view(spark, d, "doc_packs"), "p7", "source")


@query("v47_natural_order", f"{ctes('file_names')} SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place FROM file_names")
def _(spark, d):
    return evaluate.natural_order(view(spark, d, "file_names"), "image_name", "source").select("source", "doc_id", "place")


@query("v46_merge_rules", f"{ctes('doc_rules')} SELECT id, priority, count(*) OVER (PARTITION BY id) > 1 AS duplicate, row_number() OVER (ORDER BY coalesce(priority, 0) DESC, id)::INT AS place FROM doc_rules")
def _(spark, d):
    return rules.merge_rules(view(spark, d, "doc_rules")).select("id", "priority", "duplicate", "place")


# Files
@query("s01_read_answers", f"SELECT shelf, length(text)::BIGINT AS chars, sha256(text) AS sha256 FROM ({SHELVES})")
def _(spark, d):
    """Answer sheets written as files and read back whole."""
    return read_answers(spark, f"{_shelves(spark, d)}/*/*.txt").select(_shelf("answer_id"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


@query("s03_file_receipts", f"SELECT shelf, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM ({SHELVES})")
def _(spark, d):
    return file_receipts(spark, _shelves(spark, d), "*.txt").select(_shelf("path"), "bytes", "sha256")


@query("s02_read_json_documents", f"SELECT shelf, CASE WHEN shelf % 7 <> 3 THEN n END AS n, CASE WHEN shelf % 7 <> 3 THEN least END AS least, shelf % 7 = 3 AS issue FROM ({SHELVES})")
def _(spark, d):
    """A JSON file for each shelf, of which some begin with a byte order mark and some are cut off."""
    per = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / SHELF).alias("shelf")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    record = F.to_json(F.struct("shelf", "n", "least"))
    text = F.when(F.col("shelf") % 7 == 3, F.substr(record, F.lit(1), F.length(record) - 2)).when(F.col("shelf") % 3 == 0, F.concat(F.lit("\ufeff"), record)).otherwise(record)
    root = _folder(spark, "manifests")
    write_files(per.withColumn("text", text), root, "shelf", "n", "text")
    found = read_json_documents(spark, f"{root}/*/*.txt", "shelf long, n long, least long")
    return found.select(_shelf("path"), "document.n", "document.least", F.col("issue").isNotNull().alias("issue"))


@query("s05_publish", "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0")
def _(spark, d):
    """The second of two published versions."""
    root, docs = _folder(spark, "published"), table(spark, d, "documents").select("doc_id", "text")
    publish(docs.where("doc_id % 3 = 0"), root)
    publish(docs.where("doc_id % 3 <> 0"), root)
    return read_published(spark, root).select("doc_id", F.sha2("text", 256).alias("sha256"))


# Scalars
@query(
    "t50_normalize_answer",
    rf"""{ctes('answer_md')}, c AS (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE concat('```md', chr(10), text, chr(10), '```') END, '\r\n?', chr(10), 'g'), '^{S}+|{S}+$', '', 'g') AS t FROM answer_md),
u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?is)^```(?:markdown|md)?{S}*\n(.*?)\n```{S}*$', '\1'), '^{S}+|{S}+$', '', 'g') AS t FROM c)
SELECT doc_id, sha256(regexp_replace(CASE WHEN regexp_matches(t, '#{S}+(?:物理试卷参考答案|参考答案|答案)(?:{S}|$)') THEN regexp_extract(t, '(?s)#{S}+(?:物理试卷参考答案|参考答案|答案)(?:{S}.*|$)') ELSE t END, '{OPTIONS}', '\1', 'g')) AS sha256 FROM u""",
)
def _(spark, d):
    fenced = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("```md\n"), "text", F.lit("\n```")))
    return _answers(spark, d).select("doc_id", F.sha2(X.normalize_answer(fenced), 256).alias("sha256"))


#: The same record written in two ways, with nested objects in an array.
RECORDS = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('{{"z": ', props, ', "a": [ ', props, ', {{"y": 1.0, "b": ', CAST(event_id AS VARCHAR(20)), '}} ], "event": "', event_type, '"}}')
  ELSE concat('{{"event":"', event_type, '","a":[', props, ',{{"b":', CAST(event_id AS VARCHAR(20)), ',"y":1}}],"z":', props, '}}') END AS record FROM {events}"""


@query(
    "t63_open_fingerprint",
    """SELECT event_id, 'snapshot-' || substr(sha256('{"a":[{"k":' || k || '},{"b":' || event_id || ',"y":1}],"event":"' || event_type || '","z":{"k":' || k || '}}'), 1, 16) AS fingerprint
FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""",
)
def _(spark, d):
    return spark.sql(RECORDS, events=table(spark, d, "events")).select("event_id", X.open_fingerprint(F.col("record")).alias("fingerprint"))


@query("t51_join_question_leads", rf"{ctes('answer_md')} SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN replace(text, '18.' || chr(10) || chr(10) || '（1）', '18. （1）') ELSE text END) AS sha256 FROM answer_md")
def _(spark, d):
    return _answers(spark, d).select("doc_id", F.sha2(X.join_question_leads(F.col("text")), 256).alias("sha256"))


@query(
    "t52_math_segments",
    rf"""{ctes('answer_md')}, a AS (SELECT doc_id, text, regexp_replace(text, '(?s)\$\$(.+?)\$\$', '@@MATH@@', 'g') AS b FROM answer_md), m AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '(?s)\$\$(.+?)\$\$', 1), lambda x: ('display', x)), list_concat(list_transform(regexp_extract_all(b, '(?s)\\\[(.+?)\\\]', 1), lambda x: ('display', x)),
  list_transform(regexp_extract_all(regexp_replace(b, '(?s)\\\[(.+?)\\\]', '@@MATH@@', 'g'), '(?s)(^|[^\\])\$(.+?)\$', 2), lambda x: ('inline', x)))) AS s FROM a)
SELECT doc_id, seq::INT AS seq, e[1] AS mode, regexp_replace(e[2], '^{S}+|{S}+$', '', 'g') AS tex FROM (SELECT doc_id, unnest(s) AS e, unnest(range(1, len(s) + 1)) AS seq FROM m)""",
)
def _(spark, d):
    return pages.math_segments(_answers(spark, d))


@query("t53_placement_mode", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'inline-medium') AS mode FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.placement_mode(F.col("url")).alias("mode"))


@query("t54_escape_html", """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS sha256 FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.escape_html(F.col("html")), 256).alias("sha256"))


@query(
    "t55_title_and_body",
    rf"""{ctes('answer_md')}, p AS (SELECT doc_id, regexp_extract(text, '^#[ \t]+([^\n]+)', 1) AS t, text FROM answer_md)
SELECT doc_id, nullif(regexp_replace(t, '^{S}+|{S}+$', '', 'g'), '') AS title, CASE WHEN t <> '' THEN sha256(regexp_replace(regexp_replace(text, '^[^\n]*\n?', ''), '^{S}+', '')) END AS body_sha256, CASE WHEN t = '' THEN 'no title heading' END AS error FROM p""",
)
def _(spark, d):
    parts = _answers(spark, d).select("doc_id", X.title_and_body(F.col("text")).alias("p"))
    return parts.select("doc_id", "p.title", F.sha2("p.body", 256).alias("body_sha256"), "p.error")


@query("t56_assemble_layers", rf"SELECT conv_id, sha256(string_agg('## ' || role || chr(10) || chr(10) || regexp_replace(text, '^{S}+|{S}+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) || chr(10)) AS sha256 FROM conversations GROUP BY conv_id")
def _(spark, d):
    layers = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("label"), F.col("text").alias("body"))
    return pages.assemble_layers(layers, "conv_id").select("conv_id", F.sha2("text", 256).alias("sha256"))


@query("t57_join_text_layers", "SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS sha256 FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.when(F.col("role") != "system", F.col("text")).alias("text"))
    return pages.join_text_layers(rows, "conv_id").select("conv_id", F.sha2("text", 256).alias("sha256"))


# Each white space stands twice, so that a number's own may be used up when it is marked.
NUMBERED = rf"""marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(reference_text, '({S})', '\1\1', 'g'), '(^|[^0-9])((?:10|[1-9])\.{S})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM reference_keys),
found AS (SELECT doc_id, TRY_CAST(regexp_extract(p, '^(10|[1-9])\.{S}', 1) AS INT) AS q, upper(regexp_extract(p, '(?i)【{S}*答案{S}*】{S}*([A-D])', 1)) AS a FROM (SELECT doc_id, unnest(p) AS p FROM marked)),
per AS (SELECT doc_id, q, count(DISTINCT a) AS n, min(a) AS a FROM found WHERE q IS NOT NULL AND a <> '' GROUP BY ALL),
numbered AS (SELECT doc_id, CASE WHEN max(n) > 1 THEN 'conflict' WHEN count(q) = 10 THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN max(n) = 1 AND count(q) = 10 THEN string_agg(a, '' ORDER BY q) END AS answers FROM reference_keys LEFT JOIN per USING (doc_id) GROUP BY doc_id)"""
COMPACT = rf"compact AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(regexp_replace(upper(reference_text), '{S}+', '', 'g'), '([^A-Z])', '\1\1', 'g'), '(?:^|[^A-Z])([A-D]{{10}})(?:[^A-Z]|$)', 1)) AS s FROM reference_keys)"


@query("k58_numbered_keys", f"{ctes('reference_keys')}, {NUMBERED} SELECT * FROM numbered")
def _(spark, d):
    return keys.numbered_keys(view(spark, d, "reference_keys"))


@query(
    "k59_compact_keys",
    f"{ctes('reference_keys')}, {COMPACT} SELECT doc_id, CASE WHEN len(s) > 1 THEN 'conflict' WHEN len(s) = 1 THEN 'complete' ELSE 'none' END AS status, CASE WHEN len(s) = 1 THEN s[1] END AS answers FROM compact",
)
def _(spark, d):
    return keys.compact_keys(view(spark, d, "reference_keys"))


_RANGE = [f"regexp_matches(line, '^{S}*{a}{S}*[—–-]{S}*{b}{S}*[:：]')" for a, b in ((1, 5), (6, 10))]
_LETTERS = ["array_to_string(list_transform(range({0}, {0} + 5), lambda i: answers[i]), '、')".format(i) for i in (1, 6)]


@query(
    "k60_apply_keys",
    f"""{ctes('answer_md', 'reference_keys')}, {LINES}, {NUMBERED}, {COMPACT},
key AS (SELECT doc_id, CASE WHEN status = 'conflict' THEN 'conflict' WHEN status = 'complete' OR len(s) = 1 THEN 'ok' WHEN len(s) > 1 THEN 'conflict' ELSE 'no_key' END AS k, coalesce(answers, s[1]) AS answers FROM numbered JOIN compact USING (doc_id)),
shape AS (SELECT doc_id, count(*) FILTER ({_RANGE[0]}) = 1 AND count(*) FILTER ({_RANGE[1]}) = 1 AS single FROM lines GROUP BY doc_id),
fixed AS (SELECT doc_id, string_agg(CASE WHEN {_RANGE[0]} THEN '1—5：' || {_LETTERS[0]} WHEN {_RANGE[1]} THEN '6—10：' || {_LETTERS[1]} ELSE line END, chr(10) ORDER BY line_no) AS text FROM lines JOIN key USING (doc_id) WHERE k = 'ok' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN k <> 'ok' THEN k WHEN single THEN 'applied' ELSE 'bad_shape' END AS status, sha256(CASE WHEN k = 'ok' AND single THEN f.text ELSE d.text END) AS sha256
FROM answer_md d JOIN key USING (doc_id) JOIN shape USING (doc_id) LEFT JOIN fixed f ON d.doc_id = f.doc_id""",
)
def _(spark, d):
    return keys.apply_keys(_answers(spark, d).select("doc_id", "text"), view(spark, d, "reference_keys")).select("doc_id", "status", F.sha2("text", 256).alias("sha256"))


@query(
    "t61_response_text",
    "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text FROM conversations",
)
def _(spark, d):
    text = F.col("text")
    cut = F.array(F.substring("text", 1, 5), F.substr("text", F.lit(6)))
    part = lambda t: F.struct(t.alias("text"))
    json = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(text.alias("output_text"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.array(F.struct(F.transform(cut, part).alias("content"))).alias("output"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.array(F.struct(F.struct(F.transform(cut, part).alias("content")).alias("message"))).alias("choices"))))
        .otherwise(F.lit('{"choices": []}'))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", X.response_text(json).alias("text"))


@query("t62_redact_attempts", f"{ctes('attempts')} SELECT request_id, role, status::INT AS status, ok, substr(coalesce(error, ''), 1, 500) AS error FROM attempts")
def _(spark, d):
    return evaluate.redact_attempts(view(spark, d, "attempts"))


@query("t63_fingerprint", """SELECT doc_id, 'snapshot-' || substr(sha256('{"chars":' || n_chars || ',"doc":' || doc_id || ',"lang":"' || lang || '"}'), 1, 16) AS id FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.struct(F.col("n_chars").alias("chars"), F.col("doc_id").alias("doc"), "lang")).alias("id"))


@query(
    "r64_layered_resolve",
    f"""{ctes('profile_entries', 'profile_parents').replace('WITH ', 'WITH RECURSIVE ')}, own AS (SELECT DISTINCT profile_key FROM profile_entries),
up(profile_key, layer, depth) AS (SELECT profile_key, profile_key, 0 FROM own UNION ALL SELECT u.profile_key, p.parent, u.depth + 1 FROM up u JOIN profile_parents p ON u.layer = p.profile_key)
SELECT profile_key, path, value FROM (SELECT u.profile_key, e.path, e.value, row_number() OVER (PARTITION BY u.profile_key, e.path ORDER BY u.depth) AS n FROM up u JOIN profile_entries e ON u.layer = e.profile_key) WHERE n = 1""",
)
def _(spark, d):
    return rules.layered_resolve(view(spark, d, "profile_entries"), view(spark, d, "profile_parents"))


@query(
    "r70_compile_snapshots",
    f"""{ctes('rules_lit', 'profile_entries')}, own AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' ELSE 'math' END AS pack_id, 'p' || doc_id AS profile_key FROM documents),
r AS (SELECT o.pack_id, count(*)::INT AS n, string_agg('{{"enabled":' || enabled || ',"id":"' || id || '","priority":' || priority || ',"severity":"' || severity || '"}}', ',' ORDER BY priority DESC, id) AS j
  FROM (SELECT DISTINCT pack_id FROM own) o JOIN rules_lit l ON l.pack_id IN (o.pack_id, 'platform') GROUP BY o.pack_id),
p AS (SELECT profile_key, string_agg('{{"path":"' || path || '","value":"' || value || '"}}', ',' ORDER BY path) AS j FROM profile_entries GROUP BY profile_key)
SELECT pack_id, profile_key, n AS rule_count, 'snapshot-' || substr(sha256('{{"pack":"' || pack_id || '","profile":[' || p.j || '],"rules":[' || r.j || '],"version":"8.2"}}'), 1, 16) AS snapshot_id
FROM own JOIN r USING (pack_id) JOIN p USING (profile_key)""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    packs = docs.select(F.element_at(F.array(*map(F.lit, ("junior", "senior", "math"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("pack_id"), F.lit("8.2").alias("version"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("profile_key"))
    return rules.compile_snapshots(packs, view(spark, d, "rules_lit"), view(spark, d, "profile_entries")).select("pack_id", "profile_key", "rule_count", "snapshot_id")


_PACK = "CASE doc_id % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' ELSE 'math' END"
_RULE = "CASE WHEN doc_id % 8 = 0 THEN 'math' WHEN doc_id % 8 = 1 THEN 'rendering' ELSE {} END || CASE WHEN doc_id % 2 = 0 THEN '.a' ELSE '.b' END"


@query(
    "r71_foreign_rules",
    f"""WITH r AS (SELECT DISTINCT source AS snapshot_id, {_PACK} AS pack_id, {_RULE.format(_PACK)} AS rule_id FROM documents)
SELECT snapshot_id, rule_id, 'foreign' AS problem FROM r WHERE split_part(rule_id, '.', 1) IN ('junior', 'senior', 'math') AND split_part(rule_id, '.', 1) <> pack_id
UNION ALL SELECT snapshot_id, pack_id || '.a', 'missing' FROM (SELECT DISTINCT snapshot_id, pack_id FROM r) s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.snapshot_id = s.snapshot_id AND r.rule_id = s.pack_id || '.a')""",
)
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("snapshot_id"), F.expr(_PACK).alias("pack_id"), F.expr(_RULE.format(_PACK)).alias("rule_id")).distinct()
    packs = rows.select("pack_id").distinct()
    return rules.foreign_rules(rows, packs, packs.select("pack_id", F.concat("pack_id", F.lit(".a")).alias("rule_id")))


# Pages
@query(
    "p45_question_regions",
    f"""{ctes('page_sizes').replace('WITH ', 'WITH RECURSIVE ', 1)},
laid AS (SELECT doc_id, height, p AS page_no, j, (p - 1) * (doc_id % 4) + j + 1 AS n, j * 150.0 + 60 AS y FROM (SELECT *, unnest(range(1, page_count + 1)) AS p FROM page_sizes), (SELECT unnest(range(4)) AS j) WHERE j <= doc_id % 4 AND (doc_id + j) % 7 <> 0),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y, n) AS i FROM laid WHERE n < 100),
walk(doc_id, i, n, page, took) AS (SELECT doc_id, i, n, page_no, true FROM m WHERE i = 1
  UNION ALL SELECT doc_id, i, CASE WHEN took THEN own_n ELSE n END, CASE WHEN took THEN own_page ELSE page END, took FROM (SELECT m.doc_id, m.i, w.n, w.page, m.n AS own_n, m.page_no AS own_page, m.n = w.n + 1 OR (m.n = w.n AND m.page_no <> w.page) AS took FROM walk w JOIN m ON m.doc_id = w.doc_id AND m.i = w.i + 1) t),
k AS (SELECT m.doc_id, m.n, m.page_no, m.y, m.height, lead(m.y) OVER pg AS next_y, row_number() OVER pg AS nth, lag(m.n) OVER (PARTITION BY m.doc_id ORDER BY m.i) AS before FROM m JOIN walk w ON m.doc_id = w.doc_id AND m.i = w.i WHERE w.took WINDOW pg AS (PARTITION BY m.doc_id, m.page_no ORDER BY m.i))
SELECT doc_id, n::INT AS question, page_no::INT AS page_no, greatest(0, y - 24)::DOUBLE AS y0, coalesce(next_y - 24, height)::DOUBLE AS y1 FROM k
UNION ALL SELECT doc_id, before::INT, page_no::INT, 0::DOUBLE, (y - 24)::DOUBLE FROM k WHERE nth = 1 AND before <> n AND y > 24""",
)
def _(spark, d):
    i = F.col("doc_id")
    size = view(spark, d, "page_sizes").select("doc_id", "height", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    marks = size.select("doc_id", "page_no", F.col("height").alias("page_height"), F.explode(F.sequence(F.lit(0), (i % 4).cast("int"))).alias("j"))
    n = (F.col("page_no") - 1) * (i % 4) + F.col("j") + 1
    return pages.question_regions(marks.select("doc_id", "page_no", "page_height", F.concat(n.cast("string"), F.lit(".")).alias("text"), F.when((i + F.col("j")) % 7 == 0, 120.0).otherwise(40.0).alias("x"), (F.col("j") * 150 + 60).cast("double").alias("y")))


@query(
    "p65_select_pages",
    f"""{ctes('page_sizes')}, w AS (SELECT doc_id, CASE page_spec WHEN 'all' THEN range(1, page_count + 1) WHEN '1,last' THEN list_distinct([1, page_count]) WHEN '1,1-2,1' THEN CASE WHEN page_count >= 2 THEN [1, 2] END END AS p, page_spec FROM page_sizes)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1)::INT AS ord, page::INT AS page, NULL::VARCHAR AS error FROM (SELECT doc_id, unnest(p) AS page FROM w WHERE p IS NOT NULL)
UNION ALL SELECT doc_id, 0, NULL, 'bad page token: ' || CASE page_spec WHEN '1,1-2,1' THEN '1-2' ELSE page_spec END FROM w WHERE p IS NULL""",
)
def _(spark, d):
    return pages.select_pages(view(spark, d, "page_sizes"))


_EDGE = "greatest(0, floor({c} / {n} * {i} - {c} / {n} * 0.075))::INT AS {a}0, least({c}, ceil({c} / {n} * ({i} + 1) + {c} / {n} * 0.075))::INT AS {a}1"


@query(
    "p66_tile_grid",
    f"""{ctes('page_sizes')} SELECT doc_id, r::INT AS "row", c::INT AS "col", (r * 2 + c + 1)::INT AS ordinal, {_EDGE.format(c='width', n='2.0::DOUBLE', i='c', a='x')}, {_EDGE.format(c='height', n='3.0::DOUBLE', i='r', a='y')}, printf('tile-%02d.png', r * 2 + c + 1) AS name
  FROM page_sizes, (SELECT unnest(range(3)) AS r), (SELECT unnest(range(2)) AS c)""",
)
def _(spark, d):
    return pages.tile_grid(view(spark, d, "page_sizes"), 3, 2, 0.15)


# Differences


def _clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '{S}+$', '')"


def _n_lines(c: str) -> str:
    return f"len(string_split({c}, chr(10)))"



@query("f67_line_diff", f"{ctes('diff_pairs')}, c AS (SELECT pair_id, {_clean('before_text')} AS a, {_clean('after_text')} AS b FROM diff_pairs) SELECT pair_id, a = b AS equal, ({_n_lines('b')} - {_n_lines('a')})::BIGINT AS net, sha256(a) AS before_sha256, sha256(b) AS after_sha256 FROM c")
def _(spark, d):
    """The texts that the lines of the diff give again: what it keeps and removes is the text before, what it keeps and adds the one after."""
    found = diff.line_diff(diff_pairs(spark, d))
    side = lambda sign: F.sha2(F.array_join(F.transform(F.filter("lines", lambda x: ~x.startswith(sign)), lambda x: F.substr(x, F.lit(2))), "\n"), 256)
    return found.select("pair_id", ((F.col("added") == 0) & (F.col("removed") == 0)).alias("equal"), (F.col("added") - F.col("removed")).alias("net"), side("+").alias("before_sha256"), side("-").alias("after_sha256"))


@query("f68_diff_report", f"{ctes('diff_pairs')}, c AS (SELECT *, {_clean('before_text')} AS a, {_clean('after_text')} AS b FROM diff_pairs) SELECT pair_id, sha256(before_text) AS before_sha256, sha256(after_text) AS after_sha256, a <> b AS changed, ({_n_lines('b')} - {_n_lines('a')})::BIGINT AS net FROM c")
def _(spark, d):
    return diff.diff_report(diff_pairs(spark, d)).select("pair_id", "before_sha256", "after_sha256", "changed", (F.col("added") - F.col("removed")).alias("net"))


@query(
    "f69_pixel_diff",
    """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 4)::INT) AS a, lead(list_transform(embedding, lambda x: floor(x * 4)::INT)) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
n AS (SELECT vec_id, len(list_filter(range(len(a) // 4), lambda i: a[i * 4 + 1 : i * 4 + 4] <> b[i * 4 + 1 : i * 4 + 4]))::BIGINT AS differing, len(a) / 4 AS pixels FROM q WHERE b IS NOT NULL)
SELECT vec_id, true AS comparable, differing, differing / pixels AS ratio, differing / pixels <= 0.005 AS passed FROM n""",
)
def _(spark, d):
    pixels = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * 4).cast("int")).alias("before"))
    return diff.pixel_diff(pixels.withColumn("after", F.expr("lead(before) OVER (PARTITION BY label ORDER BY vec_id)")).where("after IS NOT NULL"), "vec_id")
