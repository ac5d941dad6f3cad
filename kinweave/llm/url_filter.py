"""URL filters by a temporal list join.

A list is a log of dated entries: on a day a pattern enters or leaves a list.
The log becomes validity intervals ``[valid_from, valid_to)``, and an as-of join
evaluates each capture against the entries that were active on its fetch day.

Patterns are domains (``example.org`` or ``org``, which hold for subdomains too) or a
host and the first segment of the path (``example.org/news``); an address in
brackets (``[2001:db8::1]``) is one host. Entries and captures are compared without
case, blanks around them and dots at the end of a host. Of the active entries
the longest pattern decides; at equal length the list ``allow`` wins.

The verdict hangs on host, first segment and day alone, so these are made
distinct before the join: a host with a third of all captures costs one row a
segment and day. Intervals and verdicts are written and counted; up to
``MAX_BROADCAST`` rows of them are broadcast, more are joined by a shuffle that
Spark can split.

Defined cases: a URL that is null or has no host is ``malformed``; a null fetch
day has no active entries; several entries of one pattern, list and day: a
removal wins; entries with a null or empty pattern, or a null list or day, are ignored; repeated
captures keep their rows; other columns pass through unless they have the name
of an output column, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)"
_SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)"
VERDICT = ["host", "verdict", "pattern", "listed_from"]
#: Intervals or verdicts (of about 100 bytes) that are broadcast at most.
MAX_BROADCAST = 100_000


def normal(pattern: Column) -> Column:
    """A pattern in lower case, without blanks around it and dots at the end of its host."""
    return F.regexp_replace(F.lower(F.trim(pattern)), r"\.+(?=/|$)", "")


def _sized(table: DataFrame) -> DataFrame:
    """A written table with the hint that its number of rows allows."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table.hint("merge")


def intervals(entries: DataFrame) -> DataFrame:
    """``entries (pattern, list, day, active)`` to ``(pattern, list, valid_from, valid_to)``; an open end is null.

    Only the days on which a pattern's state changes begin or end an interval.
    """
    known = entries.where("pattern is not null and list is not null and day is not null").withColumn("pattern", normal(F.col("pattern"))).where("pattern <> ''")
    daily = known.groupBy("pattern", "list", "day").agg(F.min(F.coalesce("active", F.lit(False))).alias("active"))
    order = Window.partitionBy("pattern", "list").orderBy("day")
    changed = daily.withColumn("was", F.coalesce(F.lag("active").over(order), F.lit(False))).where("active <> was")
    return (
        changed.withColumn("valid_to", F.lead("day").over(order))
        .where("active")
        .select("pattern", "list", F.col("day").alias("valid_from"), "valid_to")
    )


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures (url, fetched_on, ...)`` with ``host, verdict, pattern, listed_from`` of each."""
    url = F.lower(F.trim("url"))
    host = F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"\.+$", "")
    rest = [c for c in captures.columns if c not in VERDICT]
    base = captures.select(
        *rest,
        F.when(F.length(host) > 0, host).alias("host"),
        F.regexp_extract(F.coalesce(url, F.lit("")), _SEGMENT, 1).alias("_kw_segment"),
    )
    asked = base.where("host is not null and fetched_on is not null").select("host", "_kw_segment", "fetched_on").distinct()
    scratch = Scratch(captures.sparkSession, "url-filter")
    labels = F.when(F.col("host").startswith("["), F.array("host")).otherwise(F.split("host", r"\."))
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.col("_kw_segment") != "", F.array(F.concat_ws("/", "host", "_kw_segment"))).otherwise(F.expr("cast(array() as array<string>)"))
    spread = asked.select("host", "_kw_segment", "fetched_on", F.explode(F.concat(tails, paths)).alias("pattern"))
    active = spread.join(_sized(scratch.keep(intervals(entries), "intervals")), "pattern").where("valid_from <= fetched_on and (valid_to is null or fetched_on < valid_to)")
    rank = F.struct(F.length("pattern"), (F.col("list") == "allow").cast("int"), F.col("list"), "pattern", "valid_from")
    decided = active.groupBy("host", "_kw_segment", "fetched_on").agg(F.max(rank).alias("_kw_best"))
    # Written, so that both sides of the join back are shuffled by it alone and a hot key can be split.
    decided = scratch.keep(decided, "decided")
    joined = base.join(_sized(decided), ["host", "_kw_segment", "fetched_on"], "left")
    verdict = F.when(F.col("host").isNull(), "malformed").otherwise(F.coalesce(F.col("_kw_best.list"), F.lit("unlisted")))
    return joined.select(
        *rest, "host", verdict.alias("verdict"), F.col("_kw_best.pattern").alias("pattern"), F.col("_kw_best.valid_from").alias("listed_from")
    )


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of a table, by the digits of their MD5: for queries and tests.

    Two of three hosts are blocked from some day on, half of these leave the
    list later and some return; a few hosts' parent domains are allowed, and
    the segment ``en`` of some hosts is blocked.
    """
    host = F.regexp_extract(F.lower("url"), _HOST, 1)
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    n = lambda at, size: F.conv(F.substring(F.md5("host"), at, size), 16, 10).cast("int")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))
    hosts = hosts.select("host", n(1, 2).alias("a"), n(3, 3).alias("b"), n(6, 3).alias("c"))
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    start, stop = F.col("b") % 250, F.col("b") % 250 + 20 + F.col("c") % 90
    logs = [
        hosts.where("a % 3 <> 0").select(F.col("host").alias("pattern"), F.lit("block").alias("list"), day(start).alias("day"), F.lit(True).alias("active")),
        hosts.where("a % 3 <> 0 and a % 2 = 0").select("host", F.lit("block"), day(stop), F.lit(False)),
        hosts.where("a % 3 <> 0 and a % 4 = 0").select("host", F.lit("block"), day(stop + 30), F.lit(True)),
        hosts.where("a % 5 = 0").select(parent, F.lit("allow"), day(F.col("c") % 300), F.lit(True)),
        hosts.where("a % 7 = 1").select(F.concat("host", F.lit("/en")), F.lit("block"), day(F.col("c") % 200), F.lit(True)),
    ]
    out = logs[0]
    for log in logs[1:]:
        out = out.union(log)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int"))
    return evaluate(pages.withColumn("fetched_on", day), sample_entries(pages)).select(
        "page_id", "url", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "verdict", "pattern", F.col("listed_from").cast("string").alias("listed_from")
    )


ORACLE = r"""
WITH p AS (SELECT page_id, url, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') AS host,
    regexp_extract(coalesce(lower(url), ''), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg,
    DATE '2024-01-01' + (page_id * 37 % 365)::INT AS d FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 2))::INT AS a, ('0x' || substr(md5(host), 3, 3))::INT AS b, ('0x' || substr(md5(host), 6, 3))::INT AS c
  FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
l AS (SELECT host AS pat, 'block' AS list, b % 250 AS k, true AS act FROM h WHERE a % 3 <> 0
  UNION ALL SELECT host, 'block', b % 250 + 20 + c % 90, false FROM h WHERE a % 3 <> 0 AND a % 2 = 0
  UNION ALL SELECT host, 'block', b % 250 + 50 + c % 90, true FROM h WHERE a % 3 <> 0 AND a % 4 = 0
  UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), 'allow', c % 300, true FROM h WHERE a % 5 = 0
  UNION ALL SELECT host || '/en', 'block', c % 200, true FROM h WHERE a % 7 = 1),
g AS (SELECT pat, list, DATE '2024-01-01' + k::INT AS day, bool_and(act) AS act FROM l GROUP BY ALL),
w AS (SELECT *, coalesce(lag(act) OVER (PARTITION BY pat, list ORDER BY day), false) AS was FROM g),
v AS (SELECT pat, list, act, day AS f, lead(day) OVER (PARTITION BY pat, list ORDER BY day) AS t FROM w WHERE act <> was),
m AS (SELECT p.page_id, v.list, v.pat, v.f, row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.pat) DESC, (v.list = 'allow') DESC, v.list DESC, v.pat DESC, v.f DESC) AS r
  FROM p JOIN v ON v.act AND v.f <= p.d AND (v.t IS NULL OR p.d < v.t)
    AND (v.pat = p.host OR ends_with(p.host, '.' || v.pat) OR (p.seg <> '' AND v.pat = p.host || '/' || p.seg)))
SELECT p.page_id, p.url, p.host, p.d::VARCHAR AS fetched_on,
  CASE WHEN p.host IS NULL THEN 'malformed' ELSE coalesce(m.list, 'unlisted') END AS verdict, m.pat AS pattern, m.f::VARCHAR AS listed_from
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
"""
