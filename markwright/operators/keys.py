"""Answer keys: extraction from reference texts, and correction of candidates with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.functions import chars as C
from markwright.functions.text import unix_newlines


def _numbered(text: Column) -> Column:
    """array<struct<question, answer>> of the numbered answers in a text, in order."""
    pieces = F.split(unix_newlines(text), rf"(?<!\d)(?=(?:10|[1-9])\.{C.S}+)", -1)
    pairs = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, rf"\A(10|[1-9])\.{C.S}+", 1).try_cast("int").alias("question"), F.upper(F.regexp_extract(p, rf"(?iu)【{C.S}*答案{C.S}*】{C.S}*([A-D])", 1)).alias("answer")))
    found = F.filter(pairs, lambda p: p["question"].isNotNull() & (p["answer"] != ""))
    return F.when(text.contains("答案"), found).otherwise(F.array().cast("array<struct<question:int,answer:string>>"))


def numbered_keys(docs: DataFrame, key: str = "doc_id", text: str = "reference_text") -> DataFrame:
    """(key, status, answers): ten numbered answers as one string, or conflict, or incomplete.

    A document is judged in its row: no shuffle.
    """
    found = docs.select(key, _numbered(F.col(text)).alias("pairs"))
    return found.select(key, *_joined(F.col("pairs")))


def _joined(pairs: Column) -> tuple[Column, Column]:
    sets = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda q: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["question"] == q), lambda p: p["answer"])))
    conflict = F.exists(sets, lambda s: F.size(s) > 1)
    complete = F.forall(sets, lambda s: F.size(s) == 1)
    status = F.when(conflict, "conflict").when(complete, "complete").otherwise("incomplete")
    return status.alias("status"), F.when(complete, F.array_join(F.transform(sets, lambda s: F.get(s, F.lit(0))), "")).alias("answers")


def _compact(text: Column) -> Column:
    """Distinct ten-letter sequences in a text."""
    # Few texts have ten such letters in a row, white space aside; only those are rewritten.
    may = text.rlike(rf"(?:[A-Da-d]{C.S}*+){{10}}")
    plain = F.when(may, F.regexp_replace(F.upper(text), f"{C.S}+", "")).otherwise(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![A-Z])([A-D]{10})(?![A-Z])"), F.lit(1)))


def compact_keys(docs: DataFrame, key: str = "doc_id", text: str = "reference_text") -> DataFrame:
    """(key, status, answers): the one ten-letter sequence, or conflict, or none."""
    found = docs.select(key, _compact(F.col(text)).alias("s"))
    n = F.size("s")
    return found.select(key, F.when(n > 1, "conflict").when(n == 1, "complete").otherwise("none").alias("status"), F.when(n == 1, F.get("s", F.lit(0))).alias("answers"))


def apply_keys(candidates: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, text): candidates with the reference's answers in their two range lines.

    Status: applied, no_key, conflict, or bad_shape if there is not exactly one line of either range. The text is changed
    only if it is applied. References (key, reference_text) are reduced to a status and ten letters before the join.
    """
    numbered, compact = _joined(F.col("pairs")), F.col("s")
    keys = references.select(key, _numbered(F.col("reference_text")).alias("pairs"), _compact(F.col("reference_text")).alias("s")).select(key, *numbered, "s")
    answers = F.coalesce("answers", F.when(F.size(compact) == 1, F.get(compact, F.lit(0))))
    key_status = F.when(F.col("status") == "conflict", "conflict").when(F.col("status") == "complete", "ok").when(F.size(compact) > 1, "conflict").when(F.size(compact) == 1, "ok").otherwise("no_key")
    keys = keys.select(key, key_status.alias("key_status"), F.when(key_status == "ok", answers).alias("answers"))
    joined = candidates.join(keys, key, "left").withColumn("__lines", F.split("text", "\n", -1))
    first, second = (rf"\A{C.S}*{a}{C.S}*[—–-]{C.S}*{b}{C.S}*[:：]" for a, b in ((1, 5), (6, 10)))
    single = (F.size(F.filter("__lines", lambda x: x.rlike(first))) == 1) & (F.size(F.filter("__lines", lambda x: x.rlike(second))) == 1)
    status = F.when(F.coalesce("key_status", F.lit("no_key")) != "ok", F.coalesce("key_status", F.lit("no_key"))).when(single, "applied").otherwise("bad_shape")

    def letters(start: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(start), F.lit(start + 4)), lambda i: F.substring(F.col("answers"), i, F.lit(1))), "、")

    fixed = F.transform("__lines", lambda x: F.when(x.rlike(first), F.concat(F.lit("1—5："), letters(1))).when(x.rlike(second), F.concat(F.lit("6—10："), letters(6))).otherwise(x))
    return joined.select(key, status.alias("status"), F.when(status == "applied", F.array_join(fixed, "\n")).otherwise(F.col("text")).alias("text"))
