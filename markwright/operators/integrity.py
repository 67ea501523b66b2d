"""Deliveries against storage: what manifests declare, what is there, and what belongs together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.functions import chars as C
from markwright.functions.text import trim_space
from markwright.operators.order import small
from markwright.sources.files import cut, normal_path

# Fixed values.
OCR_STATUSES = ("not-requested", "requested", "ok", "failed")
ID_FIELDS = ("placed_graphic_id", "graphic_id", "artifact_id", "question_ref", "placement_mode")
OCR_FIELDS = ("provider", "version", "language")


def blank(c: Column) -> Column:
    return F.coalesce(trim_space(c), F.lit("")) == ""


def explode_errors(df: DataFrame, errors: Sequence[Column], *keep: str) -> DataFrame:
    """(keep..., error): a row for each error that holds."""
    return df.select(*keep, F.explode(F.array_compact(F.array(*errors))).alias("error"))


def verify_integrity(entries: DataFrame, files: DataFrame, keys: Sequence[str] = ("manifest_id", "path")) -> DataFrame:
    """(keys..., error): declared files that are missing, or differ in size or hash; both may hold."""
    current = files.select(*keys, F.col("bytes").alias("now_bytes"), F.col("sha256").alias("now_sha256"), F.lit(True).alias("there"))
    joined = entries.join(current, list(keys), "left")
    here = F.coalesce("there", F.lit(False))
    return explode_errors(joined, [F.when(~here, "missing"), F.when(here & (F.col("bytes") != F.col("now_bytes")), "bytes"), F.when(here & (F.col("sha256") != F.col("now_sha256")), "sha256")], *keys)


def undeclared_files(entries: DataFrame, files: DataFrame, keys: Sequence[str] = ("manifest_id", "path")) -> DataFrame:
    """Current files that no entry covers."""
    return files.join(entries, list(keys), "left_anti").select(*keys)


def stale_entries(entries: DataFrame, files: DataFrame, keys: Sequence[str] = ("manifest_id", "path")) -> DataFrame:
    """Entries whose file is not current."""
    return entries.join(files, list(keys), "left_anti").select(*keys)


def file_set_delta(bound: DataFrame, actual: DataFrame, keys: Sequence[str] = ("manifest_id", "path")) -> DataFrame:
    """Both differences in one pass, with the side that has the key."""
    a, b = bound.select(*keys, F.lit(True).alias("in_bound")), actual.select(*keys, F.lit(True).alias("in_actual"))
    joined = a.join(b, list(keys), "full_outer").where("in_bound IS NULL OR in_actual IS NULL")
    return joined.select(*keys, F.when(F.col("in_bound").isNull(), "actual").otherwise("bound").alias("side"))


def unequal_branches(entries: DataFrame, files: DataFrame, keys: Sequence[str] = ("manifest_id", "path"), values: Sequence[str] = ("bytes", "sha256"), leaf: int = 64) -> tuple[DataFrame, DataFrame]:
    """(entries, files): the rows of both sides that lie in branches in which the sides differ.

    The last of the keys is a path. Its branches are the folders within the other keys, and below a folder buckets of some
    `leaf` paths by hash. A branch's digest is a sum over its rows' hashes that does not depend on their order; entries count
    for it and files against it, so that one aggregation, most of which is done before its shuffle, tells which branches are
    equal. Rows of those are never shuffled. Both sides must have the values as well; keys should occur once a side: a branch
    that holds the same rows on both sides is equal, whether or not keys repeat. A branch with a null key counts as unequal.
    """
    *scope, path = keys
    by = [f"__by{i}" for i in range(len(scope))] + ["__folder"]
    same = lambda other: [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by]

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({**{c: F.col(k) for c, k in zip(by, scope, strict=False)}, "__folder": F.regexp_extract(path, r"(?s)\A(.*)/", 1), "__hash": F.xxhash64(path)})

    def digest(df: DataFrame, side: int) -> DataFrame:
        parts = [c for k in (*keys, *values) for c in (F.col(k).cast("string"), F.col(k).isNull())]
        wide = [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]
        # Halves, so that a sum of them holds for 2**31 rows.
        halves = [h for w in wide for h in (F.call_function("shiftright", w, F.lit(32)), w.bitwiseAND(F.lit(0xFFFFFFFF)))]
        unkeyed = F.greatest(*(F.col(k).isNull() for k in keys))
        return placed(df).select(*by, "__hash", unkeyed.alias("__unkeyed"), F.lit(side).cast("long").alias("__d0"), *((h * side).alias(f"__d{i + 1}") for i, h in enumerate(halves)))

    rows = digest(entries, 1).unionByName(digest(files, -1))
    sums = [f"__d{i}" for i in range(5)]
    differ = " OR ".join(["__unkeyed", *(f"{c} <> 0" for c in sums)])

    def differing(df: DataFrame, *cols: str) -> DataFrame:
        return df.groupBy(*cols).agg(*(F.sum(c).alias(c) for c in sums), F.max("__unkeyed").alias("__unkeyed"), F.count("*").alias("__n")).where(differ)

    fan = F.ceil(F.col("__n") / (2 * leaf)).cast("long").alias("__fan")
    folders = cut(differing(rows, *by).select(*(F.col(c).alias(f"f{c}") for c in by), fan))
    bucket = F.pmod(F.coalesce("__hash", F.lit(0)), "__fan").alias("__bucket")
    inside = lambda df: df.join(small(folders), same("f")).select(*(c for c in df.columns), bucket)
    low = cut(differing(inside(rows), *by, "__bucket").select(*(F.col(c).alias(f"b{c}") for c in by), F.col("__bucket").alias("b__bucket")))
    unequal = lambda df: inside(placed(df)).join(small(low), [*same("b"), F.col("__bucket") == F.col("b__bucket")], "left_semi").select(*df.columns)
    return unequal(entries), unequal(files)


def reconcile(entries: DataFrame, files: DataFrame, keys: Sequence[str] = ("manifest_id", "path"), leaf: int = 64) -> DataFrame:
    """(keys..., error): missing, bytes and sha256 as verify_integrity has them, and undeclared, from the unequal branches only.

    For two large sides that mostly agree; keys occur once a side. Missing rows are the stale entries, and with the undeclared
    ones both differences of the sets.
    """
    e, f = unequal_branches(entries, files, keys, leaf=leaf)
    return verify_integrity(e, f, keys).unionByName(undeclared_files(e, f, keys).withColumn("error", F.lit("undeclared")))


def path_collisions(inputs: DataFrame, outputs: DataFrame, run: str = "run_id", fold_case: bool = True) -> DataFrame:
    """Outputs (run, path) that would overwrite an input of their run."""
    key = F.lower("path") if fold_case else F.col("path")
    taken = inputs.select(run, key.alias("key")).distinct()
    return outputs.withColumn("key", key).join(taken, [run, "key"], "left_semi").drop("key")


def match_graphics(refs: DataFrame, placements: DataFrame) -> DataFrame:
    """(manifest_id, item, error): references without a placement, of another kind, or differing in a field the placement has."""
    there = placements.select("placement_path", F.lit(True).alias("there"), F.col("kind").alias("p_kind"), F.col("preview_path").alias("p_preview"), *(F.col(f).alias(f"p_{f}") for f in ID_FIELDS))
    joined = refs.join(there, "placement_path", "left")
    found = F.coalesce("there", F.lit(False))
    errors = [F.when(blank(F.col("placement_path")), "placement_path blank").when(~found, "placement missing"), F.when(found & ~F.col("p_kind").eqNullSafe("placed-answer-graphic"), "kind")]
    errors += [F.when(found & ~blank(F.col(f"p_{f}")) & ~F.col(f).eqNullSafe(F.col(f"p_{f}")), f) for f in ID_FIELDS]
    errors.append(F.when(found & ~blank(F.col("p_preview")) & ~F.col("preview_path").eqNullSafe(F.col("p_preview")), "preview_path"))
    return explode_errors(joined, errors, "manifest_id", "item")


def dyadic_cells(low: Column, high: Column) -> Column:
    """array<struct<level, cell>>: the fewest aligned power-of-two spans that cover the whole numbers from low to high.

    A span of a level holds 2**level numbers, and cell is its place among those. There are at most two of a level, so a
    range of n numbers has some 2 log2(n) of them; a number lies in one cell of each level. Empty where high < low or either
    is null.
    """
    first, past = low.cast("long"), high.cast("long") + 1
    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(past - first, F.lit(1)))) - 1)

    def of_level(level: Column) -> Column:
        span = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        left, right = F.call_function("shiftright", first + span - 1, level), F.call_function("shiftright", past, level)
        inside = left < right
        at = lambda cell: F.struct(level.cast("int").alias("level"), cell.cast("long").alias("cell"))
        return F.array(F.when(inside & (F.pmod(left, F.lit(2)) == 1), at(left)), F.when(inside & (F.pmod(right, F.lit(2)) == 1), at(right - 1)))

    return F.when(past > first, F.array_compact(F.flatten(F.transform(levels, of_level)))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))


def fresh_manifests(runs: DataFrame, manifests: DataFrame, keys: Sequence[str], tolerance: int = 2, width: int = 60, paths: Sequence[str] = (), complete: str | None = None) -> DataFrame:
    """(run_id, manifest_id): manifests generated from `tolerance` seconds before a run starts until as long after it ends.

    They must agree with the run in `keys`, and in `paths` once these are normal, case ignored; if `complete` names a column
    of the manifests, it must be true. A range join made an equi-join: the time of a run, in steps of `width` seconds, is
    covered by dyadic cells, some two for each doubling of its length, and a manifest lies in one cell of each level that
    some run has. A run of any length stays an equi-join; what the first and last step hold beside is filtered.
    """
    if complete:
        manifests = manifests.where(complete)
    if paths:
        same = {f"__{p}": normal_path(F.col(p)) for p in paths}
        runs, manifests, keys = runs.withColumns(same), manifests.withColumns(same), [*keys, *same]
    low, high = F.col("started_at") - F.make_interval(secs=F.lit(tolerance)), F.col("finished_at") + F.make_interval(secs=F.lit(tolerance))
    step = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width)
    cells = dyadic_cells(step(F.col("low")), step(F.col("high")))
    spread = runs.select("run_id", *keys, low.alias("low"), high.alias("high")).where("low <= high").select("*", F.inline(cells))
    # 63 at most, so that manifests are not put into levels that no run has.
    levels = sorted(r["level"] for r in spread.select("level").distinct().collect())
    made = manifests.select("manifest_id", *keys, "generated_at", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    made = made.withColumn("cell", F.call_function("shiftright", step(F.col("generated_at")), F.col("level")))
    return spread.join(made, [*keys, "level", "cell"]).where("generated_at BETWEEN low AND high").select("run_id", "manifest_id")


def drift(expected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, problem): stored texts that are missing, or differ once CRLF is LF."""
    plain = lambda c: F.replace(F.col(c), F.lit("\r\n"), F.lit("\n"))
    joined = expected.select(key, plain("text").alias("want")).join(existing.select(key, plain("text").alias("have"), F.lit(True).alias("there")), key, "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("want").eqNullSafe(F.col("have")), "different")
    return joined.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def check_manifest_fields(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(manifest_id, error): a row for each field rule that a manifest breaks.

    Files are (path, is_dir); only their paths are joined, once for each of the three that may have to exist.
    """
    files = files.select("path", "is_dir").distinct()

    def exists(df: DataFrame, column: str, name: str, is_dir: bool) -> DataFrame:
        there = files.where(F.col("is_dir") == is_dir).select(F.col("path").alias(column), F.lit(True).alias(name))
        return df.join(there, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    m = manifests.select("*", F.col("review.output_dir").alias("review_dir"), F.col("review.manifest_path").alias("review_manifest"))
    m = exists(exists(exists(m, "output", "output_there", False), "review_dir", "dir_there", True), "review_manifest", "review_there", False)
    ocr, status = F.col("ocr.status"), F.col("status")
    asked = ocr.isin("requested", "ok", "failed")
    errors = [
        F.when(~F.col("kind").eqNullSafe("delivery-manifest"), "kind"),
        F.when(~F.col("snapshot_id").eqNullSafe(F.col("snapshot.id")), "snapshot_id"),
        F.when(~F.col("profile").eqNullSafe(F.col("snapshot.profile")), "profile"),
        F.when(blank(F.col("subject_pack")), "subject_pack"),
        F.when(blank(F.col("snapshot.version")), "snapshot.version"),
        F.when(blank(F.col("snapshot.profile")), "snapshot.profile"),
        F.when(~F.lower("input").endswith(".md"), "input"),
        F.when(~F.lower("output").endswith(".pdf"), "output"),
        F.when(F.coalesce(status["delivery_complete"], F.lit(False)) & ~F.col("output_there"), "status.delivery_complete without output"),
        F.when(F.col("ocr").isNull(), "ocr").when(~F.coalesce(ocr.isin(*OCR_STATUSES), F.lit(False)), "ocr.status"),
        *(F.when(asked & blank(F.col(f"ocr.{f}")), f"ocr.{f} missing").when((ocr == "not-requested") & F.col(f"ocr.{f}").isNotNull(), f"ocr.{f} not wanted") for f in OCR_FIELDS),
        F.when((ocr == "failed") & blank(F.col("ocr.error")), "ocr.error"),
        F.when(ocr.isin(*OCR_STATUSES) & (F.col("ocr.page_count") < 0), "ocr.page_count"),
        F.when(F.col("review").isNull(), "review"),
        F.when(F.coalesce(status["review_artifact_ready"], F.lit(False)) & F.col("review").isNotNull() & ~F.col("dir_there"), "status.review_artifact_ready without directory"),
        F.when(F.coalesce(status["review_artifact_ready"], F.lit(False)) & F.col("review").isNotNull() & ~F.col("review_there"), "status.review_artifact_ready without manifest"),
        *(F.when(status[f].isNull(), f"status.{f}") for f in ("toolchain_passed", "delivery_complete", "review_artifact_ready")),
    ]
    return explode_errors(m, errors, "manifest_id")


def snapshot_consistency(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(manifest_id, error): manifests against the snapshot they refer to; the join is null-safe in what it compares."""
    there = snapshots.select(F.col("path").alias("snapshot_path"), F.lit(True).alias("there"), F.col("snapshot_id").alias("s_id"), F.col("version").alias("s_version"), F.col("profile").alias("s_profile"), F.col("pack").alias("s_pack"))
    joined = manifests.join(there, "snapshot_path", "left")
    found = F.coalesce("there", F.lit(False))
    pairs = (("snapshot_id", "s_id", "snapshot_id"), ("snapshot.id", "s_id", "snapshot.id"), ("snapshot.version", "s_version", "snapshot.version"), ("snapshot.profile", "s_profile", "snapshot.profile"), ("subject_pack", "s_pack", "subject_pack"))
    errors = [F.when(blank(F.col("snapshot_path")), "snapshot_path blank").when(~found, "snapshot missing"), *(F.when(found & ~F.col(a).eqNullSafe(F.col(b)), name) for a, b, name in pairs)]
    return explode_errors(joined, errors, "manifest_id")


def graphic_refs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, path): the answer-graphic marks of each document, trimmed, each path once, in order."""
    found = F.transform(F.regexp_extract_all("text", F.lit(C.GRAPHIC_MARK), F.lit(1)), trim_space)
    return docs.select(key, F.posexplode(F.array_distinct(F.filter(found, lambda p: p != ""))).alias("ord", "path"))


def build_manifests(runs: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """One nested manifest and its JSON for each run.

    runs are (run_id, pack, profile, toolchain_passed, keep_review), files (run_id, role, path, bytes, sha256) with roles
    input, output, snapshot and review, refs (run_id, ord, placement_path). Where runs have them, snapshot_id and
    snapshot_version go into the manifest, and ocr, a struct of status, provider, version, language, error and page_count;
    a run without one did not request it.
    """
    none = F.lit(None).cast("string")
    given = lambda c, other: F.col(c) if c in runs.columns else other
    kind = "struct<status:string,provider:string,version:string,language:string,error:string,page_count:int>"
    unasked = F.struct(F.lit(OCR_STATUSES[0]).alias("status"), *(none.alias(c) for c in ("provider", "version", "language", "error")), F.lit(None).cast("int").alias("page_count"))
    runs = runs.select("*", F.coalesce(given("ocr", F.lit(None)).cast(kind), unasked).alias("__ocr"), given("snapshot_id", none).alias("__id"), given("snapshot_version", none).alias("__version"))
    receipt = F.struct("path", "bytes", "sha256")
    of = lambda role: F.max(F.when(F.col("role") == role, receipt))
    review = F.sort_array(F.collect_list(F.when(F.col("role") == "review", receipt)))
    bound = files.groupBy("run_id").agg(of("input").alias("input"), of("output").alias("output"), of("snapshot").alias("snapshot"), review.alias("review_files"))
    items = refs.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "placement_path"))), lambda r: F.struct(r["placement_path"].alias("placement_path"))).alias("items"))
    joined = runs.join(bound, "run_id", "left").join(items, "run_id", "left")
    complete = F.col("toolchain_passed") & F.col("output").isNotNull()
    ready = F.col("keep_review") & (F.size("review_files") > 0)
    manifest = F.struct(
        F.lit("1.1").alias("schemaVersion"), F.lit("delivery-manifest").alias("kind"), F.col("__id").alias("snapshotId"),
        F.struct(F.col("__id").alias("id"), F.col("__version").alias("version"), F.col("profile").alias("profile")).alias("snapshot"), F.col("pack").alias("subjectPack"), "profile",
        F.struct(*(F.col(f"__ocr.{c}").alias(c) for c in ("status", "provider", "version", "language", "error")), F.col("__ocr.page_count").alias("pageCount")).alias("ocr"),
        F.struct(F.coalesce("items", F.array().cast("array<struct<placement_path:string>>")).alias("items")).alias("graphics"),
        F.struct(F.lit("sha256").alias("algorithm"), "input", "output", "snapshot", F.col("review_files").alias("reviewFiles")).alias("integrity"),
        F.struct(F.col("toolchain_passed").alias("toolchainPassed"), F.coalesce(complete, F.lit(False)).alias("deliveryComplete"), F.coalesce(ready, F.lit(False)).alias("reviewArtifactReady")).alias("status"),
    )
    return joined.select("run_id", manifest.alias("manifest"), F.to_json(manifest).alias("json"))


def run_receipts(phases: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, ok, n_phases, phases): phase -> struct<status, artifact, error>; a failed phase fails the run; artifacts only if it succeeded.

    error is the phase's, where the rows have such a column.
    """
    # A phase that occurs twice keeps its last row.
    phases = phases if "error" in phases.columns else phases.withColumn("error", F.lit(None).cast("string"))
    last = phases.groupBy(run, "phase").agg(F.max(F.struct("ord", "status", "artifact", "error")).alias("p"))
    per = last.groupBy(run).agg(F.bool_or(F.col("p.status") == "failed").alias("failed"), F.sort_array(F.collect_list(F.struct("phase", "p.status", "p.artifact", "p.error"))).alias("rows"))
    entries = F.transform("rows", lambda r: F.struct(r["phase"].alias("key"), F.struct(r["status"].alias("status"), F.when(~F.col("failed") & (r["status"] == "completed"), r["artifact"]).alias("artifact"), r["error"].alias("error")).alias("value")))
    return per.select(run, (~F.col("failed")).alias("ok"), F.size("rows").alias("n_phases"), F.map_from_entries(entries).alias("phases"))
