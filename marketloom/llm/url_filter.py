"""URL filters by a sort-merge range join.

A rule is a host (with all its subdomains) and a path prefix. Reversed host plus
path is the canonical key: a rule covers the interval of keys that begin with
its own. Rules open and close their intervals in one sorted sequence together
with the keys to judge; a sweep over that sequence carries the stack of nested
rules that are open, and its top is the innermost rule.

A key is looked up once for its host and once per parent domain, down to the
most labels any rule has, so each look-up meets rules of exactly one host, whose
intervals are properly nested.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.common import shuffle_partitions
from marketloom.session import stored

#: The production rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"  # the verdict where no rule fits
OPEN, PROBE, CLOSE = 0, 1, 2


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _key(host: Column, path: Column, *end: Column) -> Column:
    """Reversed labels, the byte FF (in no UTF-8 text), the path."""
    backwards = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.concat(backwards.cast("binary"), F.unhex(F.lit("FF")), path.cast("binary"), *end)


def _nested(rules: DataFrame) -> DataFrame:
    """Each rule with its stack: the rules of its host whose path its own begins with, outermost first.

    Found by equality on the path's prefixes, so the work is the rules' length.
    Of equal rules a block wins.
    """
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).filter("host <> ''")
    own = one.select("host", "path", F.concat("host", "path").alias("rule"), "verdict")
    prefix = F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k")
    prefixes = own.select("host", "path", prefix).withColumn("outer", F.expr("substring(path, 1, k)"))
    outer = own.select("host", F.col("path").alias("outer"), "rule", "verdict")
    found = prefixes.join(outer, ["host", "outer"]).groupBy("host", "path")
    entry = F.struct(F.length("outer").alias("chars"), "rule", "verdict", F.length("host").alias("host_chars"))
    return found.agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def _events(rules: DataFrame) -> DataFrame:
    nested = _nested(rules)
    side = [F.lit("").alias("host"), F.lit("").alias("path")]
    opens = nested.select(_key(F.col("host"), F.col("path")).alias("key"), F.lit(OPEN).alias("kind"), "stack", *side)
    parent = F.slice("stack", 1, F.size("stack") - 1).alias("stack")
    end = _key(F.col("host"), F.col("path"), F.unhex(F.lit("FF")))
    return opens.unionByName(nested.select(end.alias("key"), F.lit(CLOSE).alias("kind"), parent, *side))


def _probes(urls: DataFrame, labels: int) -> DataFrame:
    """One key per parent domain of each distinct (host, path), up to ``labels`` labels."""
    parts = F.split("host", r"\.")
    depth = F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1))))).alias("depth")
    some = urls.filter("host <> ''").select("host", "path", depth)
    domain = F.array_join(F.slice(parts, -F.col("depth"), F.col("depth")), ".")
    return some.select(_key(domain, F.col("path")).alias("key"), F.lit(PROBE).alias("kind"), "host", "path")


def _sweep(events: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe with the stack of rules open at its key.

    The sequence is sorted by range and written once; a partition begins with
    the stack its predecessors left open (one small row per partition). A salt
    in the sort key lets many equal probes lie in several partitions.
    """
    n = shuffle_partitions(events.sparkSession)
    both = events.unionByName(probes, allowMissingColumns=True).withColumn("salt", F.xxhash64("host"))
    ranged = both.repartitionByRange(n, "key", "kind", "salt").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "url-sweep")
    place = F.struct("key", "kind")
    ends = ranged.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), place)).alias("left_open"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("part", F.last("left_open", ignorenulls=True).over(before).alias("carried"))
    so_far = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    open_here = F.last("stack", ignorenulls=True).over(so_far)
    swept = ranged.repartitionByRange(n, "part").withColumn("open", open_here).filter(F.col("kind") == PROBE)
    # One row per partition: bounded by the number of partitions.
    joined = swept.join(F.broadcast(carried), "part")
    return joined.select("host", "path", F.coalesce("open", "carried").alias("stack"))


def url_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For distinct (host, path): the longest fitting rule and its verdict; only where one fits."""
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    swept = _sweep(_events(rules), _probes(urls.distinct(), most))
    top = swept.filter(F.size("stack") > 0).select("host", "path", F.element_at("stack", -1).alias("top"))
    longest = F.max(F.struct(F.length("top.rule"), F.col("top.host_chars"), F.col("top"))).alias("best")
    return top.groupBy("host", "path").agg(longest).select("host", "path", "best.top.rule", "best.top.verdict")


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT
) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits) and verdict.

    The longest rule (host and path together, then host) wins; without one the
    verdict is ``default``. A null url, or one without ``://``, has empty host
    and path and fits no rule. Repeated rows are all judged; an empty table gives
    no rows; other columns are ignored. Rules without a host fit nothing.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found = url_verdicts(parts.select("host", "path"), rules)
    verdict = F.coalesce("verdict", F.lit(default)).alias("verdict")
    return parts.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict)


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u
), r(verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT DISTINCT ON (host, path) host, path, rh || rp AS rule, verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  ORDER BY host, path, length(rh || rp) DESC, length(rh) DESC
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
