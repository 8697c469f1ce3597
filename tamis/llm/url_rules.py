"""URL filters by a sort-merge range join, with DataFrame functions only.

A rule names a host and a path prefix and holds for the host and all its subdomains. Under a reversed host
the URLs with a path prefix are an interval of keys. A URL is looked up under each of its parent domains that
has rules; rules open and close their intervals in the same sorted sequence, and every such event carries the
stack of nested rules that are active from there on, so the last event before a URL tells its rules. Among
the tops of a URL's stacks the longest rule wins, then the one of the longer host.

The sweep is dealt by reversed host and a salt that grows with the number of different URLs; the events are
repeated for each salt, which is their number times the salts. A host with a third of all URLs is thus cut
into many sorted runs, and equal URLs are judged once; rows of a frequent URL, or of none, meet its verdict in parts.

Null URLs and those without "://" have an empty host and path and get the default verdict. Of rules that name
the same host and path, a blocking one holds. Very long URLs are looked up whole, once for each label of their host. An
empty table gives an empty result, without rules the default verdict holds. Repeated rows are judged alike. Other columns pass through;
earlier columns of the outputs' names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.runtime import ascii_lower, broadcast_if_small, join_in_parts, written

#: Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ROWS_PER_SALT, LEAST_SALTS = 200_000, 16


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """host, path, verdict; as literal values, which no Python worker makes."""
    row = lambda r: F.struct(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True)))
    return spark.range(1).select(F.explode(F.array(*map(row, rules))).alias("r")).select("r.*")


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """www.example.org as org.example.www."""
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def events(rules: DataFrame) -> DataFrame:
    """level, key, stack: where a rule's interval begins or ends, with the rules that are active from there on."""
    rules = rules.select(reversed_host(ascii_lower(F.col("host"))).alias("level"), ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    rules = rules.groupBy("level", "host", "path").agg(F.max("verdict").alias("verdict"))
    outer = rules.select("level", F.col("path").alias("outer"), F.struct(F.length("path").alias("n"), F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    prefixes = rules.select("level", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("outer"))
    stacks = prefixes.join(outer, ["level", "outer"]).groupBy("level", "path").agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    start = F.col("path").cast("binary")
    opened = stacks.select("level", start.alias("key"), "stack")
    # no UTF-8 text has the byte FF, so this key follows every path with the prefix
    closed = stacks.select("level", F.concat(start, F.unhex(F.lit("FF"))).alias("key"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    return opened.unionByName(closed)


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict."""
    names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    source = df.select(*(F.col(c) for c in names), F.col(url).alias("__url"))
    rows = source.select(*names, url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"))
    targets = written(rows.select("host", "path").distinct())
    salts = max(LEAST_SALTS, math.ceil(targets.count() / ROWS_PER_SALT))
    marks = written(events(rules))
    levels = broadcast_if_small(marks.select("level").distinct(), 64)

    labels = F.reverse(F.split("host", "\\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    probes = targets.select("host", "path", F.explode(parents).alias("level")).join(levels, "level", "left_semi")
    probes = probes.select("level", F.col("path").cast("binary").alias("key"), F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("probe"), F.lit(None).cast(marks.schema["stack"].dataType).alias("stack"), "host", "path")
    marks = marks.select("level", "key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("probe"), "stack", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))

    sweep = Window.partitionBy("level", "salt").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = probes.unionByName(marks).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("probe = 1 AND size(active) > 0")
    top = active.select("host", "path", F.element_at("active", -1).alias("top"), F.length("level").alias("n_level"))
    best = top.groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("n"), "n_level", "top.rule", "top.verdict")).alias("best"))
    best = best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "best")
    judged = join_in_parts(rows, best, {"host": "__host", "path": "__path"})
    return judged.select(*names, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
