"""The operators over the driver tables: thin queries that derive the digest columns, and their SQL.

Every query runs its operator with production parameters over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import byte_bpe, decontaminate, hard_negatives, hilbert_shards, html_text, line_dedup, merkle, quality, secret_scan, simhash, sql, token_counts, token_files, url_rules
from tamis.llm.runtime import ascii_lower, scratch_path, table, written

TOKEN_LIMIT = 2048
#: This query has its Python workers to itself, so they may remember more.
MEMO_BYTES, STATES = 128 << 20, 200_000
SHARDS, CURVE_BITS = 16, 5
#: The id after each document in token files.
END_ID = 2
#: The folder of a ledger that is kept from run to run.
LEDGER_SETTING = "spark.tamis.ledger.dir"


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and digest both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN, drop_text=True, memo_bytes=MEMO_BYTES, states=STATES).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop_page=True)
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, by way of a ledger on disk: that of LEDGER_SETTING, which a later run finds, or else a new one.

    The blob ledger adds no kinds of spans to the base ones.
    """
    folder = spark.conf.get(LEDGER_SETTING, None) or scratch_path(spark, "ledger")
    found = secret_scan.scan_increment(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    spans = secret_scan.joined_spans(F.col("findings"))
    counts = [secret_scan.count_kind(F.col("findings"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, spans.alias("spans")).select("*", F.sha2("spans", 256).alias("base_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three or more documents dropped, but in the largest doc_id."""
    deduped = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules; urls without a rule are allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base verdict, and the weakly supervised one."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "votes", "p_good")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts, the texts over the limit, and how many code points fit it: look-ups in stored prefix tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.prefix_tables(docs, public_tokenizers.path("word_bpe_49k.json"))
    stored, limit = F.col("prefix_tokens"), F.lit(TOKEN_LIMIT)
    rows = counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_counts.tokens_in(stored).alias("n_tokens"), "prefix_tokens")
    over = F.col("n_tokens") > limit
    fits = F.when(over, token_counts.longest_within(stored, limit)).otherwise(token_counts.chars_in(stored).cast("long"))
    return rows.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), fits.alias("n_chars_within_limit"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and the components of those within three bits."""
    grouped = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, radius=3)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of benchmark items, and the items found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), drop_text=True)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 runs along a Hilbert curve over size, language and source; counts differ by one at most.

    Languages and sources are quantised in the order of their names, so that a shard holds a range of each. Equal texts are
    a group: they stand together, where the first of them by doc_id belongs.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc, content = F.crc32(F.coalesce("text", F.lit(""))), F.xxhash64(F.coalesce("text", F.lit("")), size)
    rows = written(table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32"), "lang", "source", content.alias("group")))
    together = hilbert_shards.with_group_rows(rows, "group", ["lang", "source"], ["doc_id", "lang", "source"])
    dims = [
        hilbert_shards.logarithmic(F.col("size"), CURVE_BITS, 1 << 24),
        hilbert_shards.ordered("lang", hilbert_shards.cuts(rows, "lang", CURVE_BITS)),
        hilbert_shards.ordered("source", hilbert_shards.cuts(rows, "source", CURVE_BITS)),
    ]
    placed = hilbert_shards.assign(together, dims, SHARDS, CURVE_BITS, [F.col("doc_id")], F.col("group"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its source's and the dataset's root, its proof's digest, and whether what is shown of it leads to the root.

    What is shown of a fifth of the documents, chosen by the CRC-32 of their ids, is a text in lower case.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(chosen, merkle.leaf(*fields, ascii_lower(F.col("text"))))
    leaves = docs.select("doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"), F.unhex(tampered).alias("tampered"))
    proofs = merkle.build(leaves, "source", ["doc_id"]).proofs()
    shown = F.coalesce(F.lower(F.hex("tampered")), "leaf")
    rows = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), merkle.folded(shown, F.col("left"), F.col("right")).alias("folded_root"))
    return rows.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written to flat files in the shared folder and read back from these."""
    folder = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    rows = token_files.read(spark, folder)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for each positive of each anchor: every hundredth vector, by exact inner products of whole numbers."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.taking_part(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0, scale=256.0)
    return hard_negatives.mine(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_secret_scan": op2_secret_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_rules": op5_url_rules,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_files": op12_token_files,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": sql.SECRET_SCAN,
    "op4_line_dedup": sql.LINE_DEDUP,
    "op5_url_rules": sql.URL_RULES,
    "op9_decontaminate": sql.DECONTAMINATION,
    "op11_merkle_manifest": sql.MERKLE,
    "op13_hard_negatives": sql.HARD_NEGATIVES,
}
