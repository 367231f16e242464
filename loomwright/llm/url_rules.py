"""URL filters: a sort-merge range join of reversed-host keys with nested rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels of a reversed host that make up a sweep of their own.
DEPTH = 3
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """From the first ``://`` to the next /, ?, # or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a closing U+0001: hosts under a host follow it at once in the order of keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01"))


def _group(key: Column, depth: int) -> Column:
    return F.substring_index(key, "\x01", depth)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", depth: int = DEPTH) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url; other columns are ignored).

    ``rules`` (host, path, verdict) fit a host and its subdomains where the path starts with the rule's; the rule
    of the most characters wins, of equals the one with the longer host, then the smaller path, then the smaller verdict. No
    rule: rule null and ``default``.

    Reversed hosts turn "host and subdomains" into an interval of keys. Rule hosts and the distinct hosts of the
    pages are sorted by key, in groups of the first ``depth`` labels, and swept once: intervals nest, so the last
    rule host passed carries the stack of all that may still be open, and those whose interval has ended are
    taken off. Rule hosts with fewer labels than a group's are put before each group they cover. The
    distinct hosts are found with map-side aggregation, so a host that holds a third of all pages is one row in
    the sweep; their stacks come back by a join on the host that Spark broadcasts or splits by measured size.

    A null url, or one without ``://``, has an empty host and path and fits no rule with a host. Rules that are
    null in any column are left out; repeated rules count once. Repeated pages each get a row.
    """
    pages = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").distinct().withColumn("key", host_key(F.col("host")))
    entry = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("host"), "path", "verdict", "key")
    by_host = rules.groupBy("host", "key").agg(F.collect_set(entry).alias("own"))
    # the stack of a rule host: its own rules and those of every host above it
    parts = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    chain = by_host.select("host", "key", F.explode(above).alias("up")).join(by_host.select(F.col("host").alias("up"), "own"), "up")
    stacks = chain.groupBy("host", "key").agg(F.flatten(F.collect_list("own")).alias("stack")).drop("host")

    hosts = pages.select("host").distinct().withColumn("key", host_key(F.col("host"))).withColumn("part", _group(F.col("key"), depth))
    short = F.size(F.split("key", "\x01", -1)) - 1 < depth
    covers = F.array(*(F.concat(_group(F.col("part"), k), F.lit("\x01")) for k in range(1, depth))).cast("array<string>")
    groups = hosts.select("part").distinct().select("part", F.explode(F.array_distinct(covers)).alias("key"))
    spread = groups.join(stacks.where(short), "key").select("part", "key", "stack")
    opened = stacks.where(~short).select(_group(F.col("key"), depth).alias("part"), "key", "stack").unionByName(spread)
    events = opened.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack").unionByName(hosts.select("part", "key", F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    active = swept.select("host", F.filter("stack", lambda r: F.startswith("key", r["key"])).alias("stack")).where(F.size("stack") > 0)

    fits = F.filter("stack", lambda r: F.startswith("path", r["path"]))
    order = F.array_sort(
        fits,
        lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"])
        .when(a["host_size"] != b["host_size"], b["host_size"] - a["host_size"])
        .when(a["path"] < b["path"], -1)
        .when(a["path"] > b["path"], 1)
        .when(a["verdict"] < b["verdict"], -1)
        .when(a["verdict"] > b["verdict"], 1)
        .otherwise(0),
    )
    won = F.get(order, F.lit(0))
    out = pages.join(active, "host", "left").withColumn("won", won)
    return out.select("page_id", "host", "path", F.concat("won.host", "won.path").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


SQL = """
with u as (
  select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as h, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), p as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u
), r(rule_host, rule_path, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f as (
  select page_id, host, path, rule_host || rule_path as rule, verdict,
         row_number() over (partition by page_id order by length(rule_host) + length(rule_path) desc nulls last) as k
  from p left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""
