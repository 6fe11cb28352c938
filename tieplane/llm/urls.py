"""URL rules by a sort-merge range join over reversed-host keys, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, UPPER, Scratch

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot: the keys of a host and its subdomains, and only those, start
    with the host's key, so they are one interval of the sorted keys and intervals nest or are disjoint."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def keys_above(key: Column) -> Column:
    """The key of a host and those of the hosts above it."""
    labels = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))


def swept(scratch: Scratch, name: str, events: DataFrame, starts: DataFrame, order: list[str], carry, n: int) -> DataFrame:
    """Adds to each event the stack that the last start before it in the sort order brought.

    ``starts`` has the columns of ``order`` and ``stack``, the intervals that are open from there on. Both are
    sorted together into ``n`` ranges; ``carry`` gives the stack that is open at a range's first place. One
    sort of each range serves the sweep, and even events of one key are split among ranges.
    """
    own = [c for c in events.columns if c not in order]
    none = F.lit(None).cast(starts.schema["stack"].dataType)
    nothing = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in own]
    both = events.select(*order, F.lit(1).alias("kind"), *own, none.alias("stack")).unionByName(starts.select(*order, F.lit(0).alias("kind"), *nothing, "stack"))
    # written, so that a range keeps its number
    ranges = scratch.keep(both.repartitionByRange(n, *order, "kind", "uid").withColumn("part", F.spark_partition_id()), name)
    first = ranges.groupBy("part").agg(F.min(F.struct(*order)).alias("f")).select("part", "f.*")
    carried = carry(first).select(*(F.lit("").alias(c) for c in order), F.lit(-1).alias("kind"), *nothing, "stack", "part")
    sweep = W.partitionBy("part").orderBy(*order, "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranges.unionByName(carried).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1").drop("kind", "part")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Gives each url the longest rule that fits it, and that rule's verdict.

    ``rules`` has host, path, verdict. Reversed-host keys make the hosts below a rule's host one interval, and
    the paths that start with a rule's path are one interval among that host's; intervals nest or are
    disjoint. Two sweeps in sort order each keep the stack of open intervals and drop by a prefix test those
    that have ended: the first finds the hosts with rules around each url's host, at most one a label; the
    second, over (such a host, path), the nested rules whose path starts the url's. The longest host and path
    wins; of two equally long ones the longer host; of two verdicts for one rule block.

    Returns id, host, path, rule (null without one), verdict. Null urls and such without :// have empty host
    and path and get the default; very long urls are kept whole. Repeated rows stay apart; repeated rules are
    one; null rules are ignored. An empty table gives no rows, and without rules all get the default. Other
    columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = (
        rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .dropna().groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")).withColumn("key", host_key(F.col("rule_host")))
    )
    hosts = own.select(F.col("key").alias("above")).distinct()

    def around(keys: DataFrame) -> DataFrame:
        named = [c for c in keys.columns]
        return keys.withColumn("above", F.explode(keys_above(F.col("key")))).join(hosts, "above").groupBy(*named).agg(F.collect_list("above").alias("stack"))

    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select(F.monotonically_increasing_id().alias("uid"), "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    events = urls.withColumn("key", host_key(F.col("host")))
    below = swept(scratch, "hosts", events, around(hosts.select(F.col("above").alias("key"))), ["key"], around, n)
    met = scratch.keep(below.withColumn("stack", F.filter("stack", lambda k: F.col("key").startswith(k))), "met")

    lengths = own.groupBy("key").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    item = F.struct("key", "rule_host", "rule_path", "rule_verdict")

    def opened(places: DataFrame) -> DataFrame:
        named = [c for c in places.columns]
        cuts = F.transform(F.filter("lengths", lambda x: x <= F.length("path")), lambda x: F.substring("path", F.lit(1), x))
        prefixes = places.join(lengths, "key").withColumn("rule_path", F.explode(cuts)).drop("lengths")
        return prefixes.join(own, ["key", "rule_path"]).groupBy(*named).agg(F.collect_list(item).alias("stack"))

    levels = met.filter(F.size("stack") > 0).select("uid", "id", "host", F.explode("stack").alias("key"), "path")
    along = swept(scratch, "paths", levels, opened(own.select("key", F.col("rule_path").alias("path"))), ["key", "path"], opened, n)
    fits = F.filter("stack", lambda r: (r["key"] == F.col("key")) & F.col("path").startswith(r["rule_path"]))
    order = F.transform(fits, lambda r: F.struct((F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("size"), F.length(r["rule_host"]).alias("host_size"), r["rule_verdict"].alias("verdict"), F.concat(r["rule_host"], r["rule_path"]).alias("rule")))
    judged = along.withColumn("best", F.array_max(order)).groupBy("uid").agg(F.max("best").alias("best"), F.first(F.struct("id", "host", "path")).alias("url"))
    columns = lambda at: [F.col(f"{at}id").alias(id_col), F.col(f"{at}host").alias("host"), F.col(f"{at}path").alias("path")]
    free = met.filter(F.coalesce(F.size("stack") <= 0, F.lit(True))).select(*columns(""), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.select(*columns("url."), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).unionByName(free)


def rules_frame(spark, rules=tuple(RULES)) -> DataFrame:
    rows = [F.struct(*(F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r, strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


ORACLE = """
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT u.*, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS rk
  FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE rk = 1
"""
