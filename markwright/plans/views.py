"""Views over the given tables that have the shapes the operators work on, as SQL that Spark and the oracle both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.operators.order import numbered
from markwright.sources.files import table

TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "events", "embeddings")

VIEWS: dict[str, str] = {
    "answer_md": """SELECT doc_id, source, lang, concat(
    CASE WHEN doc_id % 23 = 0 THEN concat('thinking aloud ', chr(10)) ELSE '' END,
    '# 参考答案', chr(10), chr(10),
    CASE WHEN doc_id % 5 = 0 THEN '1-5：' ELSE '1—5：' END,
    CASE WHEN doc_id % 7 = 0 THEN 'A B C D A' ELSE 'A、B、C、D、A' END, chr(10),
    '6—10：C、B、B、D、D', chr(10), chr(10),
    CASE WHEN doc_id % 3 = 0 THEN concat('18.', chr(10), chr(10), '（1）乙。') ELSE '18.（1）乙。' END, chr(10),
    CASE WHEN doc_id % 11 = 0 THEN '功率为 `P=10 W`。' ELSE '功率为 $P=10$。' END, chr(10),
    CASE WHEN doc_id % 13 = 0 THEN '作 $A、B$ 的对称点。' ELSE '作 A、B 的对称点。' END, chr(10),
    CASE WHEN doc_id % 17 = 0 THEN '效率为 $x=1。' ELSE '效率为 $x=1$。' END, chr(10),
    CASE WHEN doc_id % 19 = 0 THEN '<script>x</script>' ELSE '略' END, chr(10),
    CASE WHEN doc_id % 29 = 0 THEN concat('<!-- answer-graphic: g', CAST(doc_id % 10 AS VARCHAR(10)), '.json -->', chr(10)) ELSE '' END,
    repeat('汉', CAST(doc_id % 33 AS INT)), chr(10), replace(text, chr(13), '')) AS text,
    CASE doc_id % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' ELSE 'math' END AS pack_id
  FROM {documents}""",
    "diff_pairs": """SELECT doc_id AS pair_id, text AS before_text,
    CASE WHEN doc_id % 4 = 0 THEN text ELSE coalesce(lead(text) OVER (PARTITION BY source ORDER BY doc_id), text) END AS after_text FROM {documents}""",
    "reference_keys": """SELECT doc_id, concat(CASE WHEN doc_id % 6 = 0 THEN 'page 1 no key here'
    WHEN doc_id % 6 = 1 THEN '第1页 BAADA CBBDD 11.（1）'
    WHEN doc_id % 6 = 2 THEN 'BAADA CBBDD 略 ABCDA ABCDA'
    WHEN doc_id % 6 = 3 THEN '1. 甲【答案】B 2. 乙【答案】C 3. 丙【答案】C 4. 丁【答案】B 5. 戊【答案】C 6. 己【答案】A 7. 庚【答案】D 8. 辛【答案】D 9. 壬【答案】A 10. 癸【答案】D'
    WHEN doc_id % 6 = 4 THEN '1. 甲【答案】B 1. 甲【答案】C' ELSE '1. 甲【答案】B 2. 乙' END, chr(10), text) AS reference_text FROM {documents}""",
    "attempts": """SELECT CAST(floor(event_id / 5) AS BIGINT) AS request_id,
    CASE WHEN event_id % 5 = 0 THEN 'primary' ELSE concat('fallback_', CAST(event_id % 5 AS VARCHAR(10))) END AS role,
    CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 429 WHEN 'view' THEN 400 WHEN 'signup' THEN NULL ELSE 200 END AS status,
    event_type = 'purchase' AS ok, CASE WHEN event_type <> 'purchase' THEN concat(event_type, ' failed ', props) END AS error FROM {events}""",
    "stage_outcomes": """SELECT d.source AS comparison_key, s.stage,
    concat('model', CAST(d.doc_id % 2 AS VARCHAR(10)), '/', d.lang) AS tier, d.doc_id AS question,
    CASE WHEN l.quality IS NULL OR (s.stage = 'visualAudit' AND d.doc_id % 2 = 0) THEN 'not_evaluated' WHEN l.quality = 1 THEN 'pass' ELSE 'fail' END AS outcome
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id, (SELECT 'blind' AS stage UNION ALL SELECT 'visualAudit') s""",
    "file_entries": """SELECT source AS manifest_id, concat('f/', CAST(doc_id AS VARCHAR(20))) AS path,
    CASE WHEN doc_id % 31 = 0 THEN n_chars + 1 ELSE n_chars END AS bytes,
    CASE WHEN doc_id % 37 = 0 THEN {sha}concat(text, '!'){end} ELSE {sha}text{end} END AS sha256 FROM {documents} WHERE doc_id % 41 <> 0""",
    "file_state": """SELECT source AS manifest_id, concat('f/', CAST(doc_id AS VARCHAR(20))) AS path, n_chars AS bytes, {sha}text{end} AS sha256
  FROM {documents} WHERE doc_id % 43 <> 0""",
    "runs": """SELECT event_id AS run_id, user_id, concat('pack', CAST(user_id % 3 AS VARCHAR(10))) AS subject_pack, CASE WHEN event_id % 2 = 0 THEN 'classroom' ELSE 'compact' END AS profile, ts AS started_at,
    CASE event_id % 8 WHEN 0 THEN ts + INTERVAL 5 SECOND WHEN 1 THEN ts + INTERVAL 90 SECOND WHEN 2 THEN ts + INTERVAL 20 MINUTE WHEN 3 THEN ts + INTERVAL 6 HOUR WHEN 4 THEN ts + INTERVAL 3 DAY
      WHEN 5 THEN ts + INTERVAL 45 DAY WHEN 6 THEN ts + INTERVAL 400 DAY ELSE ts - INTERVAL 1 SECOND END AS finished_at,
    concat('a/./', CAST(user_id AS VARCHAR(20)), '.md') AS input, concat('Out/', CAST(user_id AS VARCHAR(20)), '.PDF') AS output FROM {events} WHERE event_type = 'click'""",
    "run_manifests": """SELECT event_id AS manifest_id, user_id, concat('pack', CAST(CASE WHEN event_id % 13 = 0 THEN user_id + 1 ELSE user_id END % 3 AS VARCHAR(10))) AS subject_pack,
    CASE WHEN event_id % 4 < 2 THEN 'classroom' ELSE 'compact' END AS profile, ts AS generated_at, event_id % 3 <> 0 AS complete,
    concat(CASE WHEN event_id % 2 = 0 THEN 'A//' ELSE 'a/' END, CAST(CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS VARCHAR(20)), '.md') AS input,
    concat('out/', CAST(CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END AS VARCHAR(20)), '.pdf') AS output FROM {events} WHERE event_type IN ('view', 'purchase')""",
    "run_paths": """SELECT user_id AS run_id, concat(CASE WHEN event_id % 2 = 0 THEN 'Out/F' ELSE 'out/f' END, CAST(event_id % 50 AS VARCHAR(10)), '.md') AS path, event_type FROM {events}""",
    "rules_lit": """SELECT * FROM (VALUES
  ('junior.choice-answer.compact-line', 'junior', 'choice', true, 'hard', 100), ('junior.question-lead.same-line', 'junior', 'lead', true, 'hard', 95),
  ('rendering.true-latex', 'platform', 'math', true, 'hard', 90), ('junior.math.true-latex', 'junior', 'math', true, 'hard', 90),
  ('senior.choice-answer.compact-line', 'senior', 'choice', false, 'hard', 100), ('senior.question-lead.same-line', 'senior', 'lead', true, 'soft', 95),
  ('math.derivation.stepwise', 'math', 'derivation', true, 'soft', 80)) AS t(id, pack_id, check_name, enabled, severity, priority)""",
    "doc_rules": """SELECT concat(r.id, '.', CAST(d.doc_id AS VARCHAR(20))) AS id, r.pack_id, r.check_name, r.enabled AND d.doc_id % 7 <> 0 AS enabled,
    r.severity, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(r.priority + d.doc_id % 3 AS INT) END AS priority
  FROM (SELECT CASE WHEN doc_id % 97 = 1 THEN doc_id - 1 ELSE doc_id END AS doc_id FROM {documents}) d JOIN ({rules}) r ON r.pack_id = CASE d.doc_id % 4 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' WHEN 2 THEN 'math' ELSE 'platform' END""",
    "phase_rows": """SELECT conv_id AS run_id, turn AS ord,
    CASE turn % 5 WHEN 0 THEN 'blindGeneration' WHEN 1 THEN 'visualFindings' WHEN 2 THEN 'visualMerge' WHEN 3 THEN 'referenceReview' ELSE 'delivery' END AS phase,
    CASE WHEN role = 'system' THEN 'skipped' WHEN length(text) % 17 = 0 THEN 'failed' ELSE 'completed' END AS status,
    CAST(length(text) AS BIGINT) AS artifact FROM {conversations}""",
    "page_sizes": """SELECT doc_id, CAST(1 + doc_id % 9 AS INT) AS page_count, CAST(800 + doc_id % 500 AS INT) AS width, CAST(1100 + doc_id % 700 AS INT) AS height,
    CASE WHEN doc_id % 5 = 0 THEN 'all' WHEN doc_id % 5 = 1 THEN '1,last' WHEN doc_id % 5 = 2 THEN '1,1-2,1' WHEN doc_id % 5 = 3 THEN '3-1' ELSE '99' END AS page_spec FROM {documents}""",
    "file_names": """SELECT source, doc_id, concat(source, '-v', CAST(doc_id % 4 AS VARCHAR(10)), '.', CAST(doc_id % 13 AS VARCHAR(10)), '.md') AS file_name,
    concat('p.page-', CAST(doc_id AS VARCHAR(20)), '.png') AS image_name FROM {documents}""",
    "doc_packs": """SELECT source, concat(CASE WHEN doc_id % 2 = 0 THEN 'P' ELSE 'p' END, CAST(doc_id AS VARCHAR(20))) AS pack_id, doc_id % 3 = 0 AS active FROM {documents}""",
    "profile_entries": """SELECT concat('p', CAST(doc_id AS VARCHAR(20))) AS profile_key, p.path, concat(p.path, '@', CAST(doc_id % 100 AS VARCHAR(10))) AS value
  FROM {documents} d, (SELECT 'layout.max' AS path, 2 AS m UNION ALL SELECT 'layout.target', 3 UNION ALL SELECT 'rules.limit', 5 UNION ALL SELECT 'name', 1) p WHERE d.doc_id % p.m = 0""",
    "profile_parents": """SELECT concat('p', CAST(doc_id AS VARCHAR(20))) AS profile_key, concat('p', CAST(CAST(floor(doc_id / 4) AS BIGINT) * 2 AS VARCHAR(20))) AS parent, 1 AS ord
  FROM {documents} WHERE doc_id % 3 = 1 AND CAST(floor(doc_id / 4) AS BIGINT) * 2 <> doc_id""",
    "manifests": """SELECT doc_id AS manifest_id, CASE WHEN doc_id % 53 = 0 THEN 'other' ELSE 'delivery-manifest' END AS kind,
    CASE WHEN doc_id % 47 = 0 THEN ' ' ELSE lang END AS subject_pack, concat('s', CAST(doc_id % 10 AS VARCHAR(10))) AS snapshot_id,
    concat('s', CAST(CASE WHEN doc_id % 43 = 0 THEN 99 ELSE doc_id % 10 END AS VARCHAR(10))) AS s_id, CASE WHEN doc_id % 41 = 0 THEN '' ELSE '1.0' END AS s_version,
    concat('snap/', CAST(doc_id % 11 AS VARCHAR(10)), '.json') AS snapshot_path,
    CASE WHEN doc_id % 37 = 0 THEN 'compact' ELSE 'classroom' END AS profile, 'classroom' AS s_profile,
    concat('in/', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 31 = 0 THEN '.txt' ELSE '.MD' END) AS input,
    concat('f/', CAST(doc_id AS VARCHAR(20)), '.pdf') AS output, doc_id % 2 = 0 AS delivery_complete, CASE WHEN doc_id % 29 <> 0 THEN true END AS toolchain_passed,
    CASE doc_id % 5 WHEN 0 THEN 'not-requested' WHEN 1 THEN 'ok' WHEN 2 THEN 'failed' WHEN 3 THEN 'requested' ELSE 'unknown' END AS ocr_status,
    CASE WHEN doc_id % 7 = 0 THEN 'engine' END AS ocr_provider, CASE WHEN doc_id % 3 = 0 THEN 'timeout' END AS ocr_error, CAST(doc_id % 4 AS DOUBLE) - 1 AS page_count FROM {documents}""",
}


def fill(sql: str, spark_side: bool, names: dict[str, str] | None = None) -> str:
    sha, end = ("sha2(", ", 256)") if spark_side else ("sha256(", ")")
    names = names or {t: t for t in TABLES}
    return sql.format(**names, rules=VIEWS["rules_lit"], sha=sha, end=end)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(fill(VIEWS[name], True, {t: "{" + t + "}" for t in TABLES}), **used)


def diff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of this name, without a window over the texts of a source: next ids are found on narrow rows, texts join by id."""
    docs = table(spark, sf_dir, "documents")
    places = numbered(docs.select("source", "doc_id"), [F.col("doc_id")], "source")
    after = places.select(F.col("source").alias("s"), (F.col("place") - 1).alias("p"), F.col("doc_id").alias("next_id"))
    following = places.join(after, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p"))).where("doc_id % 4 <> 0").select("doc_id", "next_id")
    named = docs.select(F.col("doc_id"), F.col("text").alias("before_text")).join(following, "doc_id", "left")
    texts = docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("after_text"))
    return named.join(texts, "next_id", "left").select(F.col("doc_id").alias("pair_id"), "before_text", F.coalesce("after_text", "before_text").alias("after_text"))


def ctes(*names: str) -> str:
    """The views as the head of an oracle: WITH a AS (...), b AS (...)."""
    return "WITH " + ",\n".join(f"{n} AS ({fill(VIEWS[n], False)})" for n in names)
