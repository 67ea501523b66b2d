"""From raw documents to a training mix: five stages, each one of the training-data operators.

run() writes what a stage returns as Parquet into the shared folder and reads it again for the next stage; what a stage
wrote for itself is removed then. A stage decides on all rows that the stage before it kept, and keeps the columns of
documents; the last adds what the mix takes.

Defined cases, for every stage: a null text is an empty one to decide on and stays null; rows without a doc_id are judged
by their text, except that near_duplicates keeps them all; of rows with equal doc_id and text near_duplicates keeps one;
rows that share an id but not a text are documents of their own;
extra columns stay, whatever their names, until the mix puts its own in place of namesakes; a table or label table without rows is let through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.llm import decontamination, near_dedup, pii, quality
from markwright.llm.common import cut, scratch, table
from markwright.llm.mixing import mix_sources


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranked classifier predicts good."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group with five-word shingle similarity 0.8 or more."""
    return near_dedup.keep_first(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, to four fifths of its five-word shingles."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars, where there is one, follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with size, source_size, target and taken, which replace columns of these names."""
    own = ("size", "source_size", "target", "taken")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in own]
    return mix_sources(docs, carry=True).where("taken > 0").select(*kept, *own)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix),
]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), keep=True)
    return docs
