"""Document fingerprints by canonical exact digest.

A text is composed (Unicode NFC), case folded, composed again, and its runs of white space become one space, none at the
ends. The canonical text is hashed by xxhash64 under two seeds to 128 bits. Documents with equal digests form a bucket;
inside buckets with more than one member the bytes are compared; where they differ, which only a hash collision can
cause, the fingerprints of that digest get the text's SHA-256 as a suffix.

Defined cases: a null text is an empty one; documents with equal texts have equal fingerprints; rows that repeat a
doc_id are separate documents next to each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import cut, partitions, small

#: Unicode white space, as one class.
WHITE = r"[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def canonical(text: str) -> Column:
    """The canonical form of a string column that has no nulls. For ASCII texts lower case is all that composing and folding do."""
    composed = f"reflect('com.ibm.icu.text.Normalizer', 'compose', {text}, false)"
    folded = f"reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {composed}, true)"
    other = F.expr(f"reflect('com.ibm.icu.text.Normalizer', 'compose', {folded}, false)")
    return F.trim(F.regexp_replace(F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(other), WHITE, " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: xxhash64 of the text, and of a marker and the text."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))))


def digested(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a struct of the digest and the SHA-256 of the canonical text."""
    df = df.withColumn("__canon", canonical(text))
    return df.withColumn(name, F.struct(digest(F.col("__canon")).alias("digest"), F.sha2("__canon", 256).alias("sha"))).drop("__canon")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, its digest (own), and text and digest of the next document in descending doc_id; after the last comes the first.

    Ids are cut into ranges at quantiles, one for each shuffle partition. A range's upper end is an id itself, and the
    document with that id is copied to the range above, where it follows the last; so no range has to look at another.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    found = base.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts"), F.max("doc_id").alias("top")).first()
    cuts = sorted({*(found["cuts"] or []), *([found["top"]] if found["top"] is not None else [])})
    base = digested(base, "text", "own")
    if not cuts:
        return base.withColumns({"next_text": F.col("text"), "next": F.col("own")})
    step = max(1, int(len(cuts) ** 0.5))
    ends, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[step - 1 :: step]))
    whole = F.size(F.filter(coarse, lambda e: e < F.col("doc_id"))) * step
    place = whole + F.size(F.filter(F.slice(ends, whole + 1, F.lit(step)), lambda e: e < F.col("doc_id")))
    placed = base.withColumn("range", F.coalesce(place, F.lit(0)))
    is_end = F.array_contains(F.slice(ends, F.col("range") + 1, F.lit(1)), F.col("doc_id"))
    after = (F.col("range") + 1) % len(cuts)
    own, above = (F.struct(r.alias("range"), F.lit(c).alias("copy")) for r, c in ((F.col("range"), 0), (after, 1)))
    copies = F.when(is_end, F.array(own, above)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", "own", F.inline(copies).alias("range", "copy"))
    after = F.expr("lead(struct(text, own)) OVER (PARTITION BY range ORDER BY copy, doc_id DESC NULLS LAST, xxhash64(text))")
    found = dealt.withColumn("after", after).where("copy = 0")
    return found.select("doc_id", "text", "own", F.coalesce("after.text", "text").alias("next_text"), F.coalesce("after.own", "own").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's with its last floor(n_chars / 2) characters replaced by the first as many (or all)
    of the next document's. A fingerprint depends on the text and on the digests that collide, never on the row, and is
    exact, so a likeness is 1 or 0.
    """
    pairs = with_next(docs)
    edited = F.concat(F.expr("substring(text, 1, n_chars - CAST(floor(n_chars / 2) AS INT))"), F.expr("substring(next_text, 1, CAST(floor(n_chars / 2) AS INT))"))
    pairs = pairs.withColumn("n_chars", F.length("text")).select("doc_id", "n_chars", "own", "next", edited.alias("edited"))
    found = cut(digested(pairs, "edited", "changed").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited"))
    bad = cut(colliding(members(docs, found.select("doc_id", "own.digest"))))
    n = bad.count()
    for name in ("own", "next", "changed"):
        if n:
            told = small(bad.select(F.col("digest").alias("__digest"), F.lit(True).alias("__bad")), n)
            found = found.join(told, F.col(f"{name}.digest") == F.col("__digest"), "left")
            mark = F.when(F.col("__bad"), F.concat_ws("-", f"{name}.digest", f"{name}.sha")).otherwise(F.col(f"{name}.digest"))
            found = found.withColumn(f"{name}_mark", mark).drop("__digest", "__bad")
        else:
            found = found.withColumn(f"{name}_mark", F.col(f"{name}.digest"))
    return found.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.col("own_mark").alias("fingerprint"), F.col("changed_mark").alias("edited_fingerprint"),
        (F.col("own_mark") == F.col("changed_mark")).cast("double").alias("near_edited"), (F.col("own_mark") == F.col("next_mark")).cast("double").alias("near_next"),
    )


def members(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, canon) of the documents whose digest more than one document has, from (doc_id, digest) of all: only these are read again."""
    buckets = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    ids = cut(digests.join(buckets, "digest", "left_semi").select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.join(small(ids).alias("i"), texts.doc_id.eqNullSafe(F.col("i.doc_id")), "left_semi")
    return chosen.select(canonical("text").alias("canon")).select(digest(F.col("canon")).alias("digest"), F.encode("canon", "UTF-8").alias("canon"))


def colliding(canon: DataFrame) -> DataFrame:
    """The digests with more than one canonical text, from (digest, canon).

    The bytes of a bucket are compared as its least and its greatest, which each task folds before the shuffle, so that
    a bucket of any size is a row for each task.
    """
    return canon.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("digest")
