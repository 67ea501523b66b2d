"""URL filters: rules by host and path, and empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted by host. A host's rate of good pages is shrunk towards its registered
domain's, that towards its suffix's, and that towards the rate of all pages: each level's posterior mean is the mean of
the beta prior of the level below, whose strength comes from the spread of the rates at that level (method of moments).
A page is blocked if the lower bound of its host's posterior is under the limit. Rules come first; of the rules that
fit, the longest wins.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: what follows up to `?`, `#` or the
end. The suffix is a host's last label, or, where a table of suffixes is given, the longest of these that the host is or
ends in; the registered domain has one label more.

Defined cases: a null url or one without `://` has empty host and path, which form a host like others; pages without an
outcome are judged and not counted; rows that repeat a page_id count each; extra columns are ignored; with no outcomes
every page not under a rule is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import cut, small

#: (host, path, verdict) of the query's rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Lower bound: so many standard deviations under the mean; a host is blocked if it is under LIMIT.
DEVIATIONS, LIMIT = 2.0, 0.75
#: A word that carries three marks or two exclamation marks at its end, and the share of such words from which a page is bad.
JUNK, JUNK_SHARE = r"[^\s<>](?:&&&|\*\*\*|%%%|\$\$\$|###|!!|(?:&amp;){3})(?:\s|<|$)", 0.2


def url_parts(url: str) -> tuple[Column, Column]:
    """Host and path of a url column."""
    rest = F.when(F.col(url).contains("://"), F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_case(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, written host and path, and its verdict; null where none fits. The list is a short literal."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def html_outcomes(pages: DataFrame) -> DataFrame:
    """page_id, url, good: 0 for pages of which JUNK_SHARE or more of the words carry runs of marks, else 1; null without html."""
    marked = F.regexp_count("html", F.lit(JUNK))
    words = F.regexp_count("html", F.lit(r"[^\s<>]+"))
    return pages.select("page_id", "url", F.when(F.col("html").isNotNull(), F.when(marked >= JUNK_SHARE * words, 0).otherwise(1)).alias("good"))


#: Reputation from the counts of each host (view hosts: host, n, good). Shared by Spark and the oracle. Strength of a
#: prior: (mean (1 - mean) - spread) / spread, with the spread of the rates beyond what their sizes explain, from 1 to 1000.
REPUTATION_SQL = """
named AS ({named}),
all_pages AS (SELECT CAST(coalesce(sum(good), 0) AS DOUBLE) AS g, CAST(coalesce(sum(n), 0) AS DOUBLE) AS m FROM named),
suffixes AS (SELECT suffix, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS g FROM named GROUP BY suffix),
domains AS (SELECT domain, min(suffix) AS suffix, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS g FROM named GROUP BY domain),
root AS (SELECT CASE WHEN m > 0 THEN (g + 1) / (m + 2) ELSE 1.0 END AS p, m FROM all_pages),
{strength_0}, {strength_1}, {strength_2},
rated_0 AS (SELECT suffix, (g + s0 * p) / (n + s0) AS mean FROM suffixes, root, strength_0),
rated_1 AS (SELECT d.domain, (g + s1 * r.mean) / (n + s1) AS mean FROM domains d JOIN rated_0 r ON d.suffix = r.suffix, strength_1),
rated_2 AS (SELECT h.host, h.n, (h.good + s2 * r.mean) AS a, (h.n - h.good + s2 * (1 - r.mean)) AS b FROM named h JOIN rated_1 r ON h.domain = r.domain, strength_2),
reputation AS (SELECT host, a / (a + b) AS mean, a / (a + b) - {deviations} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound,
    CASE WHEN m = 0 OR a / (a + b) - {deviations} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {limit} THEN 'allow' ELSE 'block' END AS judged
  FROM rated_2, root)
"""
_STRENGTH = """strength_{i} AS (SELECT CASE WHEN v <= e OR k < 2 THEN 1000.0 ELSE greatest(1.0, least(1000.0, (q * (1 - q) - (v - e)) / (v - e))) END AS s{i} FROM (
  SELECT count(*) AS k, max(q) AS q, sum(n * (g / n - q) * (g / n - q)) / sum(n) AS v, count(*) * max(q * (1 - q)) / sum(n) AS e
  FROM (SELECT CAST(n AS DOUBLE) AS n, CAST({g} AS DOUBLE) AS g, p AS q FROM {view}, root WHERE n > 0) t) u)"""


#: Hosts with their registered domain and suffix, where no table says more.
LAST_LABELS = "SELECT host, n, good, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix FROM hosts"


def with_suffixes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts, (host, n, good), with domain and suffix by a table of suffixes, (suffix), such as `co.uk`; case is ignored."""
    known = suffixes.select(F.lower("suffix").alias("tail")).distinct()
    labels = F.split("host", r"\.")
    tails = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("at", "tail"))
    longest = tails.join(small(known), "tail").groupBy("host").agg(F.min("at").alias("at"))
    at = F.coalesce("at", F.size(labels) - 1)
    rest = lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    return hosts.join(longest, "host", "left").select("host", "n", "good", rest(F.greatest(at - 1, F.lit(0))).alias("domain"), rest(at).alias("suffix"))


def reputation_sql(deviations: float = DEVIATIONS, limit: float = LIMIT, named: str = LAST_LABELS) -> str:
    """CTEs that end in `reputation` (host, mean, bound, judged)."""
    levels = {f"strength_{i}": _STRENGTH.format(i=i, view=v, g=g) for i, (v, g) in enumerate((("suffixes", "g"), ("domains", "g"), ("named", "good")))}
    return REPUTATION_SQL.format(**levels, named=named, deviations=f"CAST({deviations} AS DOUBLE)", limit=f"CAST({limit} AS DOUBLE)")


def judge(outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, deviations: float = DEVIATIONS, limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bound from (page_id, url, good); suffixes, (suffix), if there is a table of them."""
    spark = outcomes.sparkSession
    host, path = url_parts("url")
    placed = cut(outcomes.select("page_id", host.alias("host"), path.alias("path"), "good"))
    hosts = cut(placed.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))
    named = LAST_LABELS if suffixes is None else "SELECT * FROM hosts"
    hosts = hosts if suffixes is None else cut(with_suffixes(hosts, suffixes))
    known = cut(spark.sql(f"WITH hosts AS (SELECT * FROM {{h}}), {reputation_sql(deviations, limit, named)} SELECT host, bound, judged FROM reputation", h=hosts))
    rule, verdict = rule_case(rules)
    return placed.join(small(known), "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "judged").alias("verdict"), F.round("bound", 6).alias("bound"))


_CASES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_FIT = [f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in _CASES]
#: DuckDB's version of judge over html_outcomes, over a view `pages`.
ORACLE = f"""
WITH parted AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) END AS rest FROM pages),
placed AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN html IS NOT NULL THEN CASE WHEN len(regexp_extract_all(html, '{JUNK}')) >= {JUNK_SHARE} * len(regexp_extract_all(html, '[^\\s<>]+')) THEN 0 ELSE 1 END END AS good FROM parted),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS good FROM placed GROUP BY host),
{reputation_sql()}
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {f} THEN '{h + p}'" for f, (h, p, _) in zip(_FIT, _CASES, strict=True))} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(_FIT, _CASES, strict=True))} ELSE judged END AS verdict,
  round(bound, 6) AS bound
FROM placed JOIN reputation USING (host)
"""
