"""Rules and profiles: which rules hold, how severe a finding is, how layers merge, what a snapshot holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markwright.functions.text import fingerprint
from markwright.operators.order import numbered, small
from markwright.sources.files import cut

#: The check of a rule decides which findings it governs.
GOVERNS = {"choice_hyphen": "choice", "choice_spacing": "choice", "orphan_lead": "lead", "backtick_math": "math", "unbalanced_dollar": "math", "cjk_in_math": "math"}


def applicable_rules(rules: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, check_name, id, severity): the enabled rule of each check of a pack; math rules come from the platform first.

    Rules are (id, pack_id, check_name, enabled, severity, priority); a check without an enabled rule has no row.
    """
    names = F.array(
        *(F.struct(F.lit(c).alias("check_name"), F.lit(o).alias("ord"), name.alias("id")) for c, o, name in (
            ("choice", 0, F.concat("pack_id", F.lit(".choice-answer.compact-line"))), ("lead", 0, F.concat("pack_id", F.lit(".question-lead.same-line"))),
            ("math", 0, F.lit("rendering.true-latex")), ("math", 1, F.concat("pack_id", F.lit(".math.true-latex"))),
        ))
    )
    wanted = packs.select("pack_id").distinct().select("pack_id", F.inline(names))
    enabled = rules.where("enabled").select("id", "severity")
    first = Window.partitionBy("pack_id", "check_name").orderBy("ord")
    return wanted.join(enabled, "id").withColumn("n", F.row_number().over(first)).where("n = 1").select("pack_id", "check_name", "id", "severity")


def apply_severity(findings: DataFrame, applicable: DataFrame) -> DataFrame:
    """Findings (with pack_id) and their level: error under a hard rule, else warning; without a rule there is no finding.

    Raw HTML is always an error and a long line always a warning. The rules, counted, go to every task if they are few.
    """
    governed = F.create_map(*(F.lit(x) for pair in GOVERNS.items() for x in pair))
    named = findings.withColumn("check_name", F.try_element_at(governed, F.col("check")))
    joined = named.join(small(applicable.withColumnRenamed("id", "rule_id")), ["pack_id", "check_name"], "left")
    free = F.col("check").isin("raw_html", "long_line")
    level = F.when(F.col("check") == "raw_html", "error").when(free, "warning").when(F.col("severity") == "hard", "error").otherwise("warning")
    return joined.where(free | F.col("rule_id").isNotNull()).select(*findings.columns, "rule_id", level.alias("level"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge_rules(rules: DataFrame) -> DataFrame:
    """Rules of all packs with their place: priority descending (missing is 0), then id; an id that occurs twice is marked."""
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    return numbered(rules.withColumn("duplicate", twice), [F.coalesce("priority", F.lit(0)).desc(), F.col("id")])


def merge_layers(layers: DataFrame) -> DataFrame:
    """(profile_key, path, value) of profiles from layers of leaves, (profile_key, rank, path, value): the greatest rank wins.

    A scalar hides the leaves that a lower layer has below it, and leaves hide a lower scalar above them.
    """
    best = layers.groupBy("profile_key", "path").agg(F.max(F.struct("rank", "value")).alias("b")).select("profile_key", "path", "b.value", "b.rank")
    steps = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "."))
    above = best.where(F.size(steps) > 1).select("profile_key", F.explode(prefixes).alias("prefix"), F.col("path").alias("leaf"), F.col("rank").alias("leaf_rank"))
    clash = above.join(best.select("profile_key", F.col("path").alias("prefix"), F.col("rank").alias("top_rank")), ["profile_key", "prefix"])
    hidden = clash.select("profile_key", F.when(F.col("top_rank") > F.col("leaf_rank"), F.col("leaf")).otherwise(F.col("prefix")).alias("path")).distinct()
    return best.join(hidden, ["profile_key", "path"], "left_anti").select("profile_key", "path", "value")


def layered_resolve(entries: DataFrame, inherits: DataFrame) -> DataFrame:
    """(profile_key, path, value): leaf rows of profiles after inheritance.

    entries are (profile_key, path, value) leaves, inherits (profile_key, parent, ord). Each profile is resolved once, in the
    round after the last of its parents, from its own leaves and theirs as they came out; so the work follows the links, not
    the ways along them, of which stacked diamonds have exponentially many. Its own leaves come before its parents', a later
    parent's before an earlier one's; parents that are nowhere are skipped. Profiles that no round reaches have a cycle at or
    above them, and one row, `#error`.
    """
    own = entries.select("profile_key").union(inherits.select("profile_key")).distinct()
    links = inherits.join(own.withColumnRenamed("profile_key", "parent"), "parent", "left_semi")
    links = cut(links.select("profile_key", "parent", F.col("ord").cast("int").alias("ord")).distinct())
    # Of the same order the greater name comes first, so that reruns agree.
    own_rank = F.struct(F.lit(1).alias("own"), F.lit(0).alias("ord"), F.lit("").alias("parent"))
    own_leaves = entries.select("profile_key", own_rank.alias("rank"), "path", "value")
    waiting = cut(links.select("profile_key").distinct())
    resolved = cut(merge_layers(own_leaves.join(waiting, "profile_key", "left_anti")))
    while not waiting.isEmpty():
        blocked = links.join(waiting.withColumnRenamed("profile_key", "parent"), "parent", "left_semi").select("profile_key").distinct()
        still = cut(waiting.join(blocked, "profile_key", "left_semi"))
        ready = cut(waiting.join(still, "profile_key", "left_anti"))
        if ready.isEmpty():
            break
        rank = F.struct(F.lit(0).alias("own"), "ord", F.col("parent").cast("string").alias("parent"))
        now = links.join(ready, "profile_key", "left_semi")
        inherited = now.join(resolved.withColumnRenamed("profile_key", "parent"), "parent").select("profile_key", rank.alias("rank"), "path", "value")
        resolved = resolved.union(cut(merge_layers(own_leaves.join(ready, "profile_key", "left_semi").union(inherited))))
        links, waiting = cut(links.join(still, "profile_key", "left_semi")), still
    # Those left that another one left inherits from, again and again, are on a cycle or between two; the others are below one.
    core = waiting
    while not core.isEmpty():
        parents = links.join(core, "profile_key", "left_semi").select(F.col("parent").alias("profile_key")).distinct()
        inner = cut(core.join(parents, "profile_key", "left_semi"))
        if inner.count() == core.count():
            break
        core = inner
    named = waiting.join(core.withColumn("on", F.lit(True)), "profile_key", "left")
    error = F.when(F.col("on"), F.concat(F.lit("cycle at "), F.col("profile_key").cast("string"))).otherwise("cycle above")
    return resolved.unionByName(named.select("profile_key", F.lit("#error").alias("path"), error.alias("value")))


def compile_snapshots(packs: DataFrame, rules: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per (pack_id, profile_key): rules of the platform and the pack in merged order, the resolved profile, counts, and the id.

    The id covers the content only; when the snapshot was made stays outside.
    """
    own = packs.select("pack_id", "version", "profile_key")
    # A pack looks for its own rules and for the platform's: an equi-join on one key.
    wanted = own.select("pack_id").distinct().select("pack_id", F.explode(F.array_distinct(F.array("pack_id", F.lit("platform")))).alias("rule_pack"))
    ruled = wanted.join(rules.withColumnRenamed("pack_id", "rule_pack"), "rule_pack")
    order = F.sort_array(F.collect_list(F.struct((-F.coalesce("priority", F.lit(0))).alias("rank"), "id", "severity", "enabled")))
    by_pack = ruled.groupBy("pack_id").agg(F.transform(order, lambda r: F.struct(r["enabled"].alias("enabled"), r["id"].alias("id"), (-r["rank"]).alias("priority"), r["severity"].alias("severity"))).alias("rules"))
    profile = resolved.groupBy("profile_key").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("profile"))
    joined = own.join(by_pack, "pack_id", "left").join(profile, "profile_key", "left")
    content = F.struct(F.col("pack_id").alias("pack"), F.col("profile"), F.col("rules"), F.col("version"))
    return joined.select("pack_id", "profile_key", "version", "rules", "profile", F.coalesce(F.size("rules"), F.lit(0)).alias("rule_count"), fingerprint(content).alias("snapshot_id"))


def foreign_rules(snapshot_rules: DataFrame, packs: DataFrame, required: DataFrame) -> DataFrame:
    """(snapshot_id, rule_id, problem): rules whose id belongs to another pack, and required rules that are missing.

    snapshot_rules are (snapshot_id, pack_id, rule_id), required (pack_id, rule_id).
    """
    prefix = F.substring_index("rule_id", ".", 1)
    others = packs.select(F.col("pack_id").alias("owner")).distinct()
    foreign = snapshot_rules.withColumn("owner", prefix).join(small(others), "owner").where("owner <> pack_id")
    foreign = foreign.select("snapshot_id", "rule_id", F.lit("foreign").alias("problem"))
    wanted = snapshot_rules.select("snapshot_id", "pack_id").distinct().join(required, "pack_id")
    missing = wanted.join(snapshot_rules, ["snapshot_id", "rule_id"], "left_anti").select("snapshot_id", "rule_id", F.lit("missing").alias("problem"))
    return foreign.unionByName(missing)
