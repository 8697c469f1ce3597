"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version of every path is addressed by the SHA-256 of its content: a paths table has a row (path,
version, blob) for each. The ledger has a row (blob, rule_version, findings) for every blob and rule version that was
scanned, clean ones with no findings. Of a new batch only the pairs that the ledger lacks are scanned, each once,
and appended to it; the findings are joined back to all paths. A rule version is a hash of the rules. Appending what is there already changes no result. A blob that a third of all rows share is combined before
the shuffle and scanned once; where findings meet their paths, such blobs are dealt in parts.

Spans are code points, ends exclusive. Their positions come from the lengths of the pieces between matches
and of the matches, summed in order. Null texts are empty; an empty text is a clean blob. Very long texts are
scanned whole, a match is a row while spans are made. Matches that begin at the same place come in the rules' order.
Repeated rows share their blob's findings. An empty table gives an empty result and leaves the ledger as it is. Other
columns pass through whatever their names; earlier columns of the outputs' names are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.runtime import broadcast_if_small, join_in_parts, written


@dataclass(frozen=True)
class Rule:
    """kind, a pattern, and the least length of one of its groups; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed values. Letters of the keywords in either case. For access and hex the least length is part of the
#: pattern: a run too short has no part that is long enough.
RULES = (
    Rule("assign", """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    """What stands for a set of rules in the ledger: a hash of all that makes them, so that other rules never meet these findings."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


FINDINGS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"
LEDGER = f"blob string, findings {FINDINGS}, rule_version string"
#: A ledger's row goes out with at most so many bytes, or else the paths meet it by shuffle.
LEDGER_ROW_BYTES = 4_096


def address(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def paths(df: DataFrame, path: str, version: str, text: str = "text") -> DataFrame:
    """path, version, blob: where each content stands; a row for every version of every path."""
    return df.select(F.col(path).alias("path"), F.col(version).alias("version"), address(F.col(text)).alias("blob")).distinct()


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, findings: a row for each of the blobs (blob, content), with no findings for clean ones."""
    found = blobs.select("blob", "content", *(F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0)).alias(f"m{n}") for n, r in enumerate(rules)))

    def cells(n: int, rule: Rule) -> Column:
        """For each match the length before it since the last one, its own, and whether it counts."""
        long_enough = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least
        pieces = F.split("content", rule.pattern)
        made = F.zip_with(
            F.slice(pieces, 1, F.size(f"m{n}")),
            F.col(f"m{n}"),
            lambda piece, m: F.struct(F.lit(n).alias("kind_no"), F.lit(rule.kind).alias("kind"), F.length(piece).alias("gap"), F.length(m).alias("size"), long_enough(m).alias("counts")),
        )
        numbered = F.transform(made, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        return F.when(F.size(f"m{n}") > 0, numbered)

    parts = found.select("blob", *(cells(n, r).alias(f"c{n}") for n, r in enumerate(rules)))
    rows = parts.select("blob", F.explode_outer(F.flatten(F.array_compact(F.array(*(f"c{n}" for n in range(len(rules))))))).alias("c")).select("blob", "c.i", "c.x.*")
    before = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    span = F.struct((F.col("end") - F.col("size")).cast("long").alias("start"), "kind_no", F.col("end").cast("long").alias("end"), "kind")
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("counts"), span))).cast(FINDINGS).alias("findings"))


def extend_ledger(addressed: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows (blob, rule_version, findings) for the blobs (blob, content) that it lacks for these rules."""
    version = rules_version(rules)
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version).select("blob").distinct()
        addressed = addressed.join(known, "blob", "left_anti")
    blobs = addressed.select("blob", "content").dropDuplicates(["blob"])
    return scan_blobs(blobs, rules).select("blob", F.lit(version).alias("rule_version"), "findings")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of a folder; empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def append_ledger(rows: DataFrame, folder: str) -> None:
    """Adds rows to the ledger of a folder. Files are partitioned by rule version, so that a scan reads its own only."""
    rows.select("blob", "findings", "rule_version").write.mode("append").partitionBy("rule_version").parquet(folder)


def with_findings(df: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with blob and findings, from a ledger that has all of its blobs; rows of the ledger that repeat, as after overlapping runs, count once."""
    names = [c for c in df.columns if c not in ("findings", "blob")]
    found = ledger.where((F.col("rule_version") == rules_version(rules)) & (F.size("findings") > 0)).select(F.col("blob").alias("__blob"), "findings").dropDuplicates(["__blob"])
    rows = df.select(*names, address(F.col(text)).alias("blob"))
    joined = join_in_parts(rows, broadcast_if_small(found, LEDGER_ROW_BYTES), {"blob": "__blob"})
    return joined.select(*names, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def scan(df: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with blob and findings, sorted by start and kind; blobs that the ledger has for these rules aren't scanned."""
    addressed = df.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    rows = written(extend_ledger(addressed, ledger, rules))
    return with_findings(df, rows if ledger is None else rows.unionByName(ledger.select("blob", "rule_version", "findings")), text, rules)


def scan_increment(df: DataFrame, folder: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """As scan(), with the ledger of a folder: what it lacks is scanned and appended, then df is joined with it."""
    spark = df.sparkSession
    addressed = df.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    append_ledger(extend_ledger(addressed, read_ledger(spark, folder), rules), folder)
    return with_findings(df, read_ledger(spark, folder), text, rules)


def joined_spans(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda s: s["kind"] == kind)).cast("long")
