"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every window of WINNOW consecutive k-gram hashes the smallest is kept, for documents and benchmark items
alike. A shared run of SPAN = K + WINNOW - 1 words has a whole window in common and so a kept hash: the join
of the kept hashes misses no shared window of SPAN words. Hits are then extended: in documents with a common
hash, the windows that contain one are compared with the items' windows word by word, and the words inside
any that agree are hit. Items of fewer words are one window of their own length, whose hash is kept as it is.

Equal texts are handled once, under 128 bits of their content. A benchmark's hashes and windows, the texts with
a common hash and what was found go out as broadcasts only if their rows, once written, fit a fixed limit; beyond it
the joins are shuffled, and texts of many rows are dealt in parts. Which of a text's places have a common hash is a
join, not a search in its list of hashes, so the time of a very long text grows with its words. Arrays are
exploded with explode_outer throughout: for explode the optimiser adds a filter on the array's size, and with
it computes the whole array a second time below.

Null texts and texts without words have no windows and are never hit; such items have none either. Rows with
the same id keep results of their own; items with the same id are one. Null item ids count as an item whose
id is an empty string. A word in several windows is hit once. An empty benchmark hits nothing, an empty table gives an
empty result. Other columns pass through; earlier columns of the outputs' names are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.runtime import ascii_lower, broadcast_if_small, join_in_parts, written

SPAN, K = 10, 5
WINNOW = SPAN - K + 1
#: What was found in a text takes so many bytes in a broadcast at most, or else rows meet it by shuffle.
FOUND_BYTES = 1_024
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same without the letters A-Z, for counting words without lowering them first.
SEPARATORS_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), ""))


def run_at(words: str, i: Column, n: int) -> list[Column]:
    """The n words from place i on. Single places are looked up: a slice of an array costs its whole length."""
    return [F.get(words, i + j) for j in range(n)]


def grams(words: str, n: int) -> Column:
    """The hashes of all runs of n words, in order."""
    hashed = F.transform(words, lambda _, i: F.xxhash64(F.lit(n), *run_at(words, i, n)))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def kept_hashes(df: DataFrame, words: str, short: list[int]) -> DataFrame:
    """df with `kept`: the winnowed hashes, and all hashes of the short items' lengths.

    The least of every WINNOW neighbours comes by doubling; each step is a column, so that none is repeated.
    """
    done, rows = 1, df.withColumn("__least", grams(words, K))
    while done < WINNOW:
        step = min(done, WINNOW - done)
        rows = rows.withColumn("__least", F.transform("__least", lambda h, i: F.least(h, F.get("__least", i + step))))  # noqa: B023
        done += step
    kept = F.slice("__least", F.lit(1), F.greatest(F.size(words) - (SPAN - 1), F.lit(0)))
    kept = F.concat(kept, *(grams(words, n) for n in short)) if short else kept
    return rows.withColumn("kept", F.array_distinct(kept)).drop("__least")


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item, size, window: the windows of every item, as words joined by a space."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    runs = F.transform("words", lambda _, i: F.concat_ws(" ", *run_at("words", i, SPAN)))
    runs = F.slice(runs, F.lit(1), F.greatest(F.size("words") - (SPAN - 1), F.lit(1)))
    rows = items.select("item", F.least(F.size("words"), F.lit(SPAN)).alias("size"), F.explode_outer(runs).alias("window"))
    return rows.distinct()


def text_key(text: Column) -> list[Column]:
    """128 bits of a text's content."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("__ka"), F.xxhash64(F.lit(1), text).alias("__kb")]


def hits(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """__ka, __kb, n_hit, items: for the texts with any hit, the words inside and the ids of the items, sorted."""
    spark_windows = written(item_windows(benchmark, item_text, item_id))
    sizes = sorted(r[0] for r in spark_windows.select("size").distinct().collect())  # SPAN values at most
    short = [n for n in sizes if n < SPAN]
    marks = kept_hashes(benchmark.select(words_of(F.col(item_text)).alias("words")), "words", short).select(F.explode_outer("kept").alias("h")).where("h IS NOT NULL").distinct()
    marks = broadcast_if_small(written(marks), 16)

    docs = df.select(*text_key(F.col(text)), words_of(F.col(text)).alias("words"))
    kept = kept_hashes(docs, "words", short).select("__ka", "__kb", F.explode_outer("kept").alias("h"))
    matched = written(kept.join(marks, "h").select("__ka", "__kb", "h").distinct())

    texts = broadcast_if_small(matched.select("__ka", "__kb").distinct(), 16)
    found = df.select(*text_key(F.col(text)), F.col(text).alias("__text")).join(texts, ["__ka", "__kb"])
    found = written(found.dropDuplicates(["__ka", "__kb"]).select("__ka", "__kb", words_of(F.col("__text")).alias("words")))

    def starts(n: int) -> DataFrame:
        """__ka, __kb, size, start: the windows of n words that may match."""
        k = min(n, K) if n == SPAN else n
        places = found.select("__ka", "__kb", F.posexplode_outer(grams("words", k)).alias("at", "h")).join(matched, ["__ka", "__kb", "h"])
        if n < SPAN:
            return places.select("__ka", "__kb", F.lit(n).alias("size"), F.col("at").alias("start"))
        # a window of SPAN words may match if a common hash is among its WINNOW grams
        near = F.explode(F.sequence(F.greatest(F.col("at") - (WINNOW - 1), F.lit(0)), F.col("at")))
        return places.select("__ka", "__kb", F.lit(n).alias("size"), near.alias("start")).distinct()

    spots = reduce(DataFrame.unionByName, (starts(n) for n in sizes or [SPAN])).groupBy("__ka", "__kb").agg(F.collect_list(F.struct("size", "start")).alias("at"))
    def window(w: Column) -> Column:
        """A place with its words."""
        runs = (F.when((w["size"] == n) & (w["start"] + n <= F.size("words")), F.concat_ws(" ", *run_at("words", w["start"], n))) for n in sizes or [SPAN])
        return F.struct(w["size"].alias("size"), w["start"].alias("start"), F.coalesce(*runs).alias("window"))

    spots = found.join(spots, ["__ka", "__kb"]).select("__ka", "__kb", F.explode_outer(F.transform("at", window)).alias("w")).select("__ka", "__kb", "w.*")
    windows = written(spark_windows.groupBy("size", "window").agg(F.sort_array(F.collect_set("item")).alias("ids")))
    hit = written(spots.join(windows, ["size", "window"]).select("__ka", "__kb", "start", "size", "ids"))

    before = Window.partitionBy("__ka", "__kb").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    covered = hit.withColumn("fresh", fresh).groupBy("__ka", "__kb").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = hit.select("__ka", "__kb", F.explode("ids").alias("item")).distinct().groupBy("__ka", "__kb").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return written(covered.join(items, ["__ka", "__kb"]))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", drop_text: bool = False) -> DataFrame:
    """df with n_words, n_hit, items (the sorted ids of the items found) and contaminated."""
    names = [c for c in df.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    found = hits(df, benchmark, text, item_text, item_id)
    kept = [c for c in names if not (drop_text and c == text)]
    rows = df.select(*kept, *text_key(F.col(text)), count_words(F.col(text)).cast("long").alias("n_words"))
    found = broadcast_if_small(found.select(F.col("__ka").alias("__fa"), F.col("__kb").alias("__fb"), "n_hit", "items"), FOUND_BYTES)
    return join_in_parts(rows, found, {"__ka": "__fa", "__kb": "__fb"}).select(
        *kept,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
