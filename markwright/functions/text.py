"""Scalar functions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.functions import chars as C


#: White space but for the line feed.
BLANK = C.SPACE.replace(r"\n", "")
#: The characters of C.SPACE themselves, for the built-in trims, which look at the ends only.
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def trim_end(text: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.rtrim(text, F.lit(SPACE_CHARS))


def unix_newlines(text: Column) -> Column:
    """CRLF and lone CR as LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """The lines of a text; CRLF ends a line as LF does, a lone CR stays; an empty text has one empty line."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def text_receipt(text: Column) -> Column:
    """struct<bytes, sha256> of the text as UTF-8."""
    return F.struct(F.octet_length(text).cast("long").alias("bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"))


def normalize_answer(text: Column) -> Column:
    """A model's output as an answer sheet: one outer fence off, nothing before the answer heading, option lists out of math."""
    clean = trim_space(unix_newlines(F.coalesce(text, F.lit(""))))
    # Most texts have no fence, and nothing to trim after the first time.
    opened = F.regexp_replace(clean, rf"(?i)\A```(?:markdown|md)?[{BLANK}]*+\n", "")
    whole = clean.startswith("```") & (F.length(opened) < F.length(clean)) & opened.endswith("\n```")
    unfenced = F.when(whole, trim_space(F.substring(opened, F.lit(1), F.length(opened) - 4))).otherwise(clean)
    # From the heading to the end as one match: places of regexp_instr are not code points.
    answer = F.coalesce(F.nullif(F.regexp_extract(unfenced, rf"{C.ANSWER_HEADING}(?s:.*)", 0), F.lit("")), unfenced)
    return F.when(answer.contains("$"), F.regexp_replace(answer, C.OPTION_LIST, "$1")).otherwise(answer)


def join_question_leads(text: Column) -> Column:
    """A line that holds only a marked question number, joined to the next non-blank line if that starts a sub-question."""
    clean = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    pattern = rf"(?m)^([{BLANK}]*{C.LEAD_MARKED})(?=[{BLANK}]*+\n){C.S}++(?={C.SUB_NUMBER})"
    return F.regexp_replace(clean, pattern, "$1 ")


def placement_mode(mode: Column) -> Column:
    """A placement mode as a safe name; inline-medium if nothing is left."""
    safe = F.regexp_replace(F.lower(trim_space(F.coalesce(mode, F.lit("inline-medium")))), "[^a-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"\A-+|-+\z", ""), F.lit("")), F.lit("inline-medium"))


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def title_and_body(text: Column) -> Column:
    """struct<title, body, error>: the first line's heading and the rest without leading white space; an error if there is none."""
    clean = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    title = F.regexp_extract(clean, r"\A#[ \t]+([^\n]+)", 1)
    found = title != ""
    body = F.regexp_replace(F.regexp_replace(clean, r"\A[^\n]*\n?", ""), rf"\A{C.S}++", "")
    return F.struct(F.when(found, trim_space(title)).alias("title"), F.when(found, body).alias("body"), F.when(~found, F.lit("no title heading")).alias("error"))


def response_text(json: Column) -> Column:
    """The text of a model response: output_text, else the texts of output, else the first choice's content; else empty."""
    v = F.try_parse_json(json)

    def string(x: Column, path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))

    def listed(x: Column, path: str) -> Column:
        return F.try_variant_get(x, path, "array<variant>")

    parts = F.flatten(F.transform(listed(v, "$.output"), lambda item: F.coalesce(F.transform(listed(item, "$.content"), lambda p: string(p, "$.text")), F.array().cast("array<string>"))))
    parts = F.array_compact(parts)
    content = F.transform(listed(v, "$.choices[0].message.content"), lambda p: F.coalesce(string(p, "$.text"), F.lit("")))
    return F.coalesce(string(v, "$.output_text"), F.when(F.size(parts) > 0, F.array_join(parts, "")), string(v, "$.choices[0].message.content"), F.array_join(content, ""), F.lit(""))


def same_bag(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often, in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def in_key_order(value: Column, kind: T.DataType) -> Column:
    """A value of this type with the fields of its structs in key order, and the entries of its maps, at every depth."""
    if isinstance(kind, T.StructType):
        fields = [in_key_order(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: in_key_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), in_key_order(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def fingerprint(payload: Column, kind: T.DataType | None = None) -> Column:
    """snapshot- and 16 hexadecimal digits of the SHA-256 of a struct's JSON.

    Keys come in order at every depth if the type is given; else the struct's fields must already stand in key order.
    """
    ordered = payload if kind is None else in_key_order(payload, kind)
    return F.concat(F.lit("snapshot-"), F.substring(F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256), 1, 16))


def canonical_json(text: Column) -> Column:
    """JSON of any shape with the keys of its objects in order at every depth, and no white space; null if it can't be read.

    A variant keeps the fields of an object in key order, so writing it out again is enough; a number is written without
    trailing zeros.
    """
    return F.to_json(F.try_parse_json(text))


def open_fingerprint(text: Column) -> Column:
    """fingerprint() of JSON whose type is not declared."""
    return F.concat(F.lit("snapshot-"), F.substring(F.sha2(canonical_json(text), 256), 1, 16))


def natural_key(name: Column) -> Column:
    """A sort key under which runs of digits of any length compare as numbers, case ignored first.

    A run stands as the number of its digits, leading zeros aside, and the digits.
    """
    number = lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d)
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"\A\d"), number(F.regexp_replace(r, r"\A0+(?=\d)", ""))).otherwise(r)), "")


def retryable(status: Column) -> Column:
    """Whether a provider's failure may be tried elsewhere; null is a network failure."""
    return status.isNull() | status.isin(*C.RETRYABLE)


def provider_order(role: Column) -> Column:
    """primary first, then fallbacks by number, then others."""
    n = F.regexp_extract(role, r"\Afallback_(\d+)\z", 1)
    return F.when(role == "primary", 0).when(n != "", n.try_cast("int")).otherwise(999)


def version_key(name: Column) -> Column:
    """array<int> of v<major>.<minor> in a file name; null if there is none."""
    v = F.regexp_extract(name, r"v(\d+\.\d+)", 1)
    return F.when(v != "", F.transform(F.split(v, r"\."), lambda x: x.try_cast("int")))


def version_numbers(version: Column) -> Column:
    """array<int> of the parts of a dotted version; a part that is no number is null, which comes first."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
