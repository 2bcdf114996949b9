"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

A rule is (host, path, action). It fits its host and all subdomains when the url's path starts with the rule's path.
Only suffixes with as many labels, and prefixes with as many characters, as some rule has are expanded, so a
url of any length gives few expressions and no rule is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query op1_url_filter.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Hex digits of the digest that are joined on.
PREFIX = 8
#: Rules up to here are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased. Path: then up to ?, # or end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with digest; null parts drop a rule, and of equal rules a block wins."""
    r = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", F.lower("action").alias("action")).where("host IS NOT NULL AND path IS NOT NULL AND action IN ('allow', 'block')")
    r = r.groupBy("host", "path").agg(F.max("action").alias("action"))
    rule = F.concat("host", "path")
    return r.select(rule.alias("rule"), F.length("host").alias("host_length"), "action", F.sha2(rule, 256).alias("digest"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url; other columns are ignored).

    The longest fitting rule decides (then the longer host, then block); rule is null and the verdict the default where
    none fits. A null url, or one without ://, has an empty host and path. Repeated rows are each judged. Without
    rules every url gets the default; without pages the result is empty.
    """
    r = prepared_rules(rules)
    shape = r.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("path_length")).alias("lengths")).first()
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shape["labels"]:
        return p.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    suffixes = F.filter(F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.greatest(F.size(parts) - (k - 1), F.lit(1)), k), ".")) for k in shape["labels"]]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape["lengths"]]), lambda x: x.isNotNull())
    # Equal urls of a page collapse to one row with a count, which the last step undoes.
    p = p.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: F.concat(s, x))))
    e = p.withColumn("expression", F.explode_outer(expressions)).withColumn("digest", F.sha2("expression", 256)).drop("expression")
    e = e.withColumn("prefix", F.substring("digest", 1, PREFIX))
    r = r.select(F.substring("digest", 1, PREFIX).alias("prefix"), F.col("digest").alias("rule_digest"), F.struct(F.length("rule").alias("length"), "host_length", F.col("action").alias("action"), "rule").alias("found"))
    if fits(r, broadcast_rules):
        joined = e.join(F.broadcast(r), "prefix", "left")
    else:  # most expressions meet no rule: only those that do go on
        joined = e.join(r, "prefix", "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))
    best = joined.groupBy("page_id", "host", "path").agg(F.max(confirmed).alias("found"), F.max("copies").alias("copies"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return best.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.action"), F.lit(default)).alias("verdict"))


def brute_force(url: str | None, rules: list[tuple[str, str, str]], default: str = "allow") -> tuple[str, str, str | None, str]:
    """The same for one url, rule by rule; for tests."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), len(h), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = reduce(max, fit) if fit else (0, 0, default, None)
    return host, path, best[3], best[2]


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for op1_url_filter."""
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in rules)
    return f"""
WITH rest AS (
  SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, k, regexp_extract(r, '^[^/?#]*') AS raw, r FROM rest
), urls AS (
  SELECT page_id, k, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM parts
), rules(rule_host, rule_path, action) AS (VALUES {values}),
best AS (
  SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM urls LEFT JOIN best USING (k)
"""
