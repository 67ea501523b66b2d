"""Pages: which ones are wanted, where their questions stand, how they are cut into tiles, what layers they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwright.functions.text import trim_space


def select_pages(docs: DataFrame, key: str = "doc_id", count: str = "page_count", spec: str = "page_spec") -> DataFrame:
    """(key, ord, page, error): the pages of a specification `all` or `1,3,5-7,last`, each once, in order of first mention.

    A bad token, a reversed range or a page outside 1..count makes one row with an error and no page.
    """
    n = F.col(count)
    text = F.lower(trim_space(F.coalesce(spec, F.lit("all"))))
    tokens = F.transform(F.split(F.when(text == "all", F.concat(F.lit("1-"), n.cast("string"))).otherwise(text), ","), trim_space)

    def number(t: Column) -> Column:
        return F.when(t == "last", n).when(t.rlike(r"\A\d{1,9}\z"), t.try_cast("int"))

    def bounds(t: Column) -> Column:
        low, high = number(F.regexp_extract(t, r"\A(\d+|last)", 1)), number(F.regexp_extract(t, r"(\d+|last)\z", 1))
        good = t.rlike(r"\A(?:\d+|last)(?:-(?:\d+|last))?\z") & (low >= 1) & (low <= high) & (high <= n)
        return F.struct(low.alias("low"), high.alias("high"), F.coalesce(good, F.lit(False)).alias("good"), t.alias("token"))

    parsed = docs.select(key, F.transform(tokens, bounds).alias("t"))
    bad = F.get(F.filter("t", lambda b: ~b["good"]), F.lit(0))
    pages = F.array_distinct(F.flatten(F.transform("t", lambda b: F.sequence(b["low"], b["high"]))))
    wanted = parsed.select(key, F.when(bad.isNull(), pages).otherwise(F.array(F.lit(None).cast("int"))).alias("p"), F.when(bad.isNotNull(), F.concat(F.lit("bad page token: "), bad["token"])).alias("error"))
    return wanted.select(key, "error", F.posexplode("p").alias("ord", "page")).select(key, "ord", "page", "error")


def tile_grid(pages: DataFrame, vertical: int, horizontal: int, overlap: float, key: str = "doc_id") -> DataFrame:
    """(key, row, col, ordinal, x0, y0, x1, y1, name): overlapping tiles, clipped to the page, numbered row by row."""
    size = lambda c, n: F.col(c) / n
    margin = lambda c, n: size(c, n) * (overlap / 2)
    cells = pages.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(vertical - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(horizontal - 1))))

    def edge(c: str, n: int, i: str) -> tuple[Column, Column]:
        low = F.greatest(F.lit(0), F.floor(size(c, n) * F.col(i) - margin(c, n)))
        high = F.least(F.col(c), F.ceil(size(c, n) * (F.col(i) + 1) + margin(c, n)))
        return low.cast("int"), high.cast("int")

    (x0, x1), (y0, y1) = edge("width", horizontal, "col"), edge("height", vertical, "row")
    ordinal = F.col("row") * horizontal + F.col("col") + 1
    return cells.select(key, "row", "col", ordinal.alias("ordinal"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.format_string("tile-%02d.png", ordinal).alias("name"))


def question_regions(markers: DataFrame, scale: float = 1.0, key: str = "doc_id") -> DataFrame:
    """(key, question, page_no, y0, y1): regions of the questions on each page.

    markers are (key, page_no, page_height, text, x, y). A marker counts if it reads `n.`, stands within 90 of the left,
    and continues the sequence, or repeats the running number as the first of a page; the running number goes on over
    pages. A region goes from its marker to the next one, with a margin; a page's top belongs to the question before.
    """
    margin = max(24, round(16 * scale))
    found = markers.where(F.col("text").rlike(r"\A\d{1,2}\.\z") & (F.col("x") <= 90)).withColumn("n", F.regexp_extract("text", r"\d+", 0).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "y", "n", "page_height")))
    kept = "array<struct<page_no:int,y:double,n:int,page_height:int>>"
    zero = F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("page"), F.array().cast(kept).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        take = acc["n"].isNull() | (m["n"] == acc["n"] + 1) | ((m["n"] == acc["n"]) & (m["page_no"] != acc["page"]))
        return F.struct(F.when(take, m["n"]).otherwise(acc["n"]).alias("n"), F.when(take, m["page_no"]).otherwise(acc["page"]).alias("page"), F.when(take, F.concat(acc["out"], F.array(m).cast(kept))).otherwise(acc["out"]).alias("out"))

    per = found.groupBy(key).agg(F.aggregate(ordered, zero, step, lambda acc: acc["out"]).alias("m"))
    rows = per.select(key, F.posexplode("m").alias("i", "m")).select(key, "i", "m.*")
    page = Window.partitionBy(key, "page_no").orderBy("i")
    doc = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumns({"next_y": F.lead("y").over(page), "first": F.row_number().over(page) == 1, "before": F.lag("n").over(doc)})
    own = rows.select(key, F.col("n").alias("question"), "page_no", F.greatest(F.lit(0.0), F.col("y") - margin).alias("y0"), F.coalesce(F.col("next_y") - margin, F.col("page_height").cast("double")).alias("y1"))
    top = rows.where(F.col("first") & F.col("before").isNotNull() & (F.col("before") != F.col("n")) & (F.col("y") - margin > 0))
    return own.unionByName(top.select(key, F.col("before").alias("question"), "page_no", F.lit(0.0).alias("y0"), (F.col("y") - margin).alias("y1")))


def assemble_layers(layers: DataFrame, key: str) -> DataFrame:
    """(key, text): layers (key, ord, label, body) as one document of sections, one newline at the end."""
    section = F.concat(F.lit("## "), F.col("label"), F.lit("\n\n"), trim_space(F.coalesce("body", F.lit(""))))
    rows = F.array_sort(F.collect_list(F.struct("ord", section.alias("s"))))
    return layers.groupBy(key).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["s"]), "\n\n"), F.lit("\n")).alias("text"))


def join_text_layers(pages: DataFrame, key: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """(key, text): page texts (key, ord, text) in page order, with a separator; pages without text are skipped."""
    kept = pages.where(F.coalesce(trim_space(F.col("text")), F.lit("")) != "")
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return kept.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias("text"))


def math_segments(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    r"""(key, seq, mode, tex): `$$…$$` first, then `\[…\]`, then `$…$` on what is left."""
    token = "@@MATH@@"
    first, second, third = r"(?s)\$\$(.+?)\$\$", r"(?s)\\\[(.+?)\\\]", r"(?s)(\A|[^\\])\$(.+?)\$"
    after_first = F.regexp_replace("text", first, token)
    # Past the last closing bracket no opening one has a partner; each would be looked for up to the end.
    rest = F.substring_index(after_first, r"\]", -1)
    closed = F.left(after_first, F.length(after_first) - F.length(rest))
    after_second = F.concat(F.regexp_replace(closed, second, token), rest)

    def rows(text: Column | str, pattern: str, group: int, mode: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda t: F.struct(F.lit(mode).alias("mode"), trim_space(t).alias("tex")))

    found = F.concat(rows("text", first, 1, "display"), rows(closed, second, 1, "display"), rows(after_second, third, 2, "inline"))
    return docs.select(key, F.posexplode(found).alias("i", "m")).select(key, (F.col("i") + 1).alias("seq"), "m.mode", "m.tex")
