"""Files as tables and tables as files. All paths are read and written by Spark."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwright.functions.text import text_receipt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_answers(spark: SparkSession, glob: str) -> DataFrame:
    """(answer_id, text): one row for each Markdown file, the id being its path."""
    rows = spark.read.text(glob, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("answer_id"), F.col("value").alias("text"))


def read_json_documents(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """(path, document, issue): a byte order mark is dropped; a file that can't be read as the schema has a null document and an issue."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\A\x{FEFF}", "").alias("text"))
    parsed = rows.withColumn("document", F.when(F.try_parse_json("text").isNotNull(), F.from_json("text", schema)))
    return parsed.select("path", "document", F.when(F.col("document").isNull(), F.concat(F.lit("unreadable JSON: "), "path")).alias("issue"))


#: Larger files are hashed as a stream, in blocks of this many bytes.
WHOLE, BLOCK = 64 << 20, 4 << 20


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            local = urlsplit(path).scheme in ("", "file")
            system, inner = (fs.LocalFileSystem(), path.removeprefix("file:")) if local else fs.FileSystem.from_uri(quote(path, safe="/:@"))
            n, digest = 0, hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while block := stream.read(BLOCK):
                    n += len(block)
                    digest.update(block)
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [n], "sha256": [digest.hexdigest()]})


def file_receipts(spark: SparkSession, root: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, bytes, sha256) of every file under a directory, of any size.

    Spark lists the files. Those of up to `whole` bytes are hashed by its built-ins, contents dropped in the same projection;
    larger ones, which would not fit into a row, are dealt by path and read as a stream of blocks by the task that has them.
    Those need a file system that Arrow can open: local, HDFS, S3, GCS. Spark's scans pass over empty files; they are what its
    listing has beside, which is fetched only if it has more files than the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = files.where(F.col("length") <= whole).select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path").repartition("path")
    receipts = rows.unionByName(large.mapInArrow(_hash_streams, "path string, bytes long, sha256 string"))
    if len(files._jdf.inputFiles()) == files.count():
        return receipts
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "value string")
    # The listing's names are encoded, and write local paths with three slashes.
    listed = listed.select(F.regexp_replace(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))), r"\Afile:///", "file:/").alias("path"))
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return receipts.unionByName(empty)


def text_receipts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bytes, sha256) of texts in a table."""
    return df.select(key, text_receipt(F.col(text)).alias("r")).select(key, "r.bytes", "r.sha256")


def write_table(df: DataFrame, path: str, as_json: bool = False) -> None:
    """All or nothing, by Spark's commit protocol: Parquet, or JSON lines for manifests."""
    writer = df.write.mode("overwrite")
    writer.json(path) if as_json else writer.parquet(path)


#: The file of a published folder that names the version to read.
CURRENT = "CURRENT"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, root: str) -> str:
    """Write df as a new version under root, then point readers to it by one rename; returns the version's folder.

    Readers see the old version or the new one, whole. A writer that dies leaves a version that nothing points to; versions
    are kept, so a reader that has begun ends well.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    named, system = _file_system(spark, f"{root}/{CURRENT}.{version}")
    out = system.create(named, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = [system.makeQualified(p) for p in (named, _file_system(spark, f"{root}/{CURRENT}")[0])]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), spark._jsc.hadoopConfiguration()).rename(*qualified, options)
    return f"{root}/{version}"


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The version of root that is current now."""
    version = spark.read.text(f"{root}/{CURRENT}", wholetext=True).first()["value"].strip()
    return spark.read.parquet(f"{root}/{version}")


def write_files(df: DataFrame, path: str, by: str, order: str, text: str) -> None:
    """A folder by=value for each value of a column, with one file of its rows' texts, a line end after each, in order.

    Rows of a value are written by one task, as a stream.
    """
    dealt = df.select(by, order, F.coalesce(text, F.lit("")).alias("value")).repartition(by).sortWithinPartitions(by, order)
    dealt.select(by, "value").write.mode("errorifexists").partitionBy(by).text(path)


def normal_path(path: Column) -> Column:
    """A path for comparison: forward slashes, no single dots or doubled slashes, case folded."""
    slashes = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?:/\.?)+/", "/")
    return F.lower(F.regexp_replace(slashes, r"\A(?:\./)+", ""))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it names none and all runs in one process, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="markwright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Paths of the tables that were cut since each open scratch() began, the innermost last.
_scratch: list[list[str]] = []


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are removed at the end, but those cut with keep."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
