"""Corpus lint: findings of answer sheets under a rule set and a layout profile.

Checks work on the array of a document's lines inside its row, so that no line crosses a shuffle; only findings are
exploded. A finding is (check, line_no, detail); line_no is null for the document as a whole. Severity comes later, from
the rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.functions import chars as C
from markwright.functions.text import split_lines

FINDING = "array<struct<check:string,line_no:int,detail:string>>"


def to_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(split_lines(F.col(text))).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def may_hit(line: Column) -> Column:
    """Whether a check of single lines can find something: a number first, a backtick, or a CJK character.

    A pattern with \\A alone in front is tried once, and lines of one byte a character have no CJK.
    """
    return line.rlike(rf"\A{C.S}*+\d") | line.contains("`") | ((F.octet_length(line) > F.length(line)) & line.rlike(C.CJK))


def number_lines(lines: Column) -> Column:
    """array<struct<i, x>>: lines with their place from 0."""
    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def _found(check: str, lines: Column, hit: Callable[[Column], Column], numbered: Column | None = None) -> Column:
    """A finding for each line that hit accepts; numbered: the lines to look at, if not all."""
    hits = F.filter(number_lines(lines) if numbered is None else numbered, lambda p: hit(p["x"]))
    return F.transform(hits, lambda p: F.struct(F.lit(check).alias("check"), (p["i"] + 1).cast("int").alias("line_no"), p["x"].alias("detail")))


def choice_hyphen(lines: Column, numbered: Column | None = None) -> Column:
    """Answer ranges written with an ASCII hyphen."""
    return _found("choice_hyphen", lines, lambda x: x.rlike(rf"\A{C.S}*{C.CHOICE_HYPHEN}"), numbered)


def choice_spacing(lines: Column, numbered: Column | None = None) -> Column:
    """Options separated by white space after the head of an answer range."""
    return _found("choice_spacing", lines, lambda x: x.rlike(rf"\A{C.S}*{C.CHOICE_HEAD}") & F.regexp_replace(x, rf"\A{C.S}*{C.CHOICE_HEAD}{C.S}*", "").rlike(C.CHOICE_GAP), numbered)


def orphan_lead(lines: Column) -> Column:
    """A question number alone on its line although the next non-blank line starts its first sub-question.

    The non-blank lines are paired with the ones after them in one pass.
    """
    solid = F.filter(number_lines(lines), lambda p: p["x"].rlike(rf"[^{C.SPACE}]"))

    def lead(p: Column, after: Column) -> Column:
        starts = p["x"].rlike(rf"\A{C.LEAD_ONLY}\z") & after["x"].rlike(rf"\A{C.SUB_QUESTION}")
        return F.when(starts, F.struct(F.lit("orphan_lead").alias("check"), (p["i"] + 1).cast("int").alias("line_no"), p["x"].alias("detail")))

    return F.array_compact(F.zip_with(solid, F.slice(solid, F.lit(2), F.greatest(F.size(solid), F.lit(1))), lead))


def backtick_math(lines: Column, numbered: Column | None = None) -> Column:
    """Formulas and units in backticks."""
    return _found("backtick_math", lines, lambda x: x.contains("`") & x.rlike(C.BACKTICK_MATH), numbered)


def long_lines(lines: Column, limit: Column, numbered: Column | None = None) -> Column:
    """Plain-text lines with more CJK characters than the limit."""

    starts = "|".join(map(re.escape, C.NOT_PLAIN_START))
    special = rf"\A{C.S}*(?:{starts}|\z)|\$\$|[=\\]"
    # A CJK character has three bytes, so short lines need no count, and few lines the other tests.
    cjk = lambda x: F.length(F.regexp_replace(x, rf"[^{C.CJK[1:-1]}]+", ""))
    return _found("long_line", lines, lambda x: (F.octet_length(x) > limit * 3) & (cjk(x) > limit) & ~x.rlike(special), numbered)


def unbalanced_dollar(text: Column) -> Column:
    """One finding for a document with an odd count of dollar signs that no backslash precedes."""
    odd = F.regexp_count(text, F.lit(r"\$(?<!\\\$)")) % 2 == 1
    return F.when(odd, F.array(F.struct(F.lit("unbalanced_dollar").alias("check"), F.lit(None).cast("int").alias("line_no"), F.lit("$").alias("detail")))).otherwise(F.array().cast(FINDING))


def cjk_in_math(text: Column) -> Column:
    """A finding for each math fence with a CJK mark, at the line of its first one."""
    pieces, fences = F.split(text, C.MATH_FENCE, -1), F.regexp_extract_all(text, F.lit(C.MATH_FENCE), F.lit(0))

    def breaks(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    zero = F.struct(F.lit(1).alias("line"), F.array().cast(FINDING).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        mark = F.regexp_extract(p["f"], C.CJK_MARK, 0)
        line = acc["line"] + breaks(p["b"])
        at = line + breaks(F.split_part(p["f"], F.when(mark != "", mark).otherwise(F.lit("\x00")), F.lit(1)))
        finding = F.struct(F.lit("cjk_in_math").alias("check"), at.cast("int").alias("line_no"), mark.alias("detail"))
        return F.struct((line + breaks(p["f"])).alias("line"), F.when(mark != "", F.concat(acc["out"], F.array(finding))).otherwise(acc["out"]).alias("out"))

    parts = F.zip_with(F.slice(pieces, F.lit(1), F.size(fences)), fences, lambda b, f: F.struct(b.alias("b"), f.alias("f")))
    # Lines are counted only in texts that have a mark in a fence.
    marked = text.contains("$") & F.exists(fences, lambda f: f.rlike(C.CJK_MARK))
    return F.when(marked, F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(FINDING))


def raw_html(text: Column) -> Column:
    """The first executable tag, whatever the rules; at most one finding."""
    tag = F.regexp_extract(text, f"(?iu){C.RAW_HTML}", 0)
    return F.when(text.contains("<") & (tag != ""), F.array(F.struct(F.lit("raw_html").alias("check"), F.lit(None).cast("int").alias("line_no"), tag.alias("detail")))).otherwise(F.array().cast(FINDING))


def explode_findings(docs: DataFrame, found: Column, *keep: str) -> DataFrame:
    return docs.select(*keep, F.inline(found))


def lint(docs: DataFrame, limit: Column | None = None, *keep: str) -> DataFrame:
    """All findings of the documents (with the columns `keep`), without severity. Also for streams: it keeps no state."""
    text, lines, some = F.col("text"), F.col("__lines"), F.col("__some")
    limit = F.lit(C.DEFAULT_LINE_LIMIT) if limit is None else limit
    # One look at each line leaves few for the checks of single lines; leads are looked for only where there is one alone.
    lead = F.when(F.exists(some, lambda p: p["x"].rlike(rf"\A{C.LEAD_ONLY}\z")), orphan_lead(lines)).otherwise(F.array().cast(FINDING))
    parts = (choice_hyphen(lines, some), choice_spacing(lines, some), lead, backtick_math(lines, some), unbalanced_dollar(text), cjk_in_math(text), raw_html(text), long_lines(lines, limit, some))
    docs = docs.withColumn("__lines", split_lines(text)).withColumn("__some", F.filter(number_lines(lines), lambda p: may_hit(p["x"])))
    return explode_findings(docs, F.concat(*(p.cast(FINDING) for p in parts)), *keep)


def resolve_line_limit(*places: Column) -> Column:
    """The first limit that is set, else the default."""
    return F.coalesce(*places, F.lit(C.DEFAULT_LINE_LIMIT))


def scan_terms(docs: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """(key, ord, term) for every listed term a document holds, in list order; the list is part of the plan."""
    listed = F.array(*map(F.lit, terms))
    hits = F.filter(F.transform(listed, lambda t, i: F.struct((i + 1).cast("int").alias("ord"), t.alias("term"))), lambda p: F.contains(F.col("text"), p["term"]))
    return docs.select(key, F.inline(hits))


def require_marker(docs: DataFrame, marker: str, key: str = "doc_id") -> DataFrame:
    """(key) of the documents that lack a passage."""
    return docs.where(~F.coalesce(F.contains("text", F.lit(marker)), F.lit(False))).select(key)
