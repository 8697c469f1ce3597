"""Losses at checkpoints: prefix means, trajectories and their statistics.

The bundled provider is a surrogate, not a language model: a token's loss is its unigram information in
millionths of a nat, scaled by a factor that grows (perturbation series) or falls (training series) with the
checkpoint. Whole numbers make results independent of the order of summation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.common import remove, scratch_path, stored, written

#: What a token's factor depends on beside the checkpoint: under 97, and over -97 for negative ids.
PHASE = "(sample_id * 7919 + CAST(t AS BIGINT) * 104729) % 97"
SERIES = {"perturbation": "1000 + {j} * (100 + {phase})", "training": "2000 - {j} * (100 + {phase})"}


def parse_checkpoints(spec: str) -> set[int]:
    """1-5,8,10-12 as a set, ranges inclusive; None is the empty set."""
    if spec.strip().lower() == "none":
        return set()
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        match = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not match:
            raise ValueError(f"not a checkpoint or range: {part!r}")
        first, last = int(match[1]), int(match[2] or match[1])
        if last < first:
            raise ValueError(f"range runs backwards: {part!r}")
        found |= set(range(first, last + 1))
    return found


def prune_checkpoints(losses: DataFrame, spec: str, column: str = "ckpt") -> DataFrame:
    """The rows of the named checkpoints; on a table partitioned by checkpoint only their files are read. It is an error if none is named."""
    wanted = sorted(parse_checkpoints(spec))
    if not wanted:
        raise ValueError("no checkpoint is named")
    return losses.where(F.col(column).isin(wanted))


def require_checkpoints(losses: DataFrame, spec: str, column: str = "ckpt") -> DataFrame:
    """As prune_checkpoints, with an error for checkpoints that the table lacks."""
    pruned = prune_checkpoints(losses, spec, column)
    there = {r[0] for r in pruned.select(column).distinct().collect()}
    if missing := parse_checkpoints(spec) - there:
        raise ValueError(f"no losses for checkpoints {sorted(missing)}")
    return pruned


def prefix_mean(losses: Column, n: int) -> Column:
    """The mean of the first n values, all if n is -1 or beyond the end; 0 if there are none."""
    taken = losses if n < 0 else F.slice(losses, 1, n)
    total = F.aggregate(taken, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(losses), F.lit(0)) <= 0, F.lit(0.0)).otherwise(total / (F.size(losses) if n < 0 else F.least(F.lit(n), F.size(losses))))


def prefix_means(df: DataFrame, windows: list[int], losses: str = "losses") -> DataFrame:
    """df with a column mean_N for every window (mean_full for -1), in one pass over the arrays."""
    return df.select("*", *(prefix_mean(F.col(losses), n).alias(f"mean_{'full' if n < 0 else n}") for n in windows))


def response_losses(parts: Column) -> Column:
    """The losses of a split sample: reasoning, then answer."""
    return F.concat(F.coalesce(parts["reasoning"], F.array().cast("array<float>")), F.coalesce(parts["answer"], F.array().cast("array<float>")))


def valid_losses(losses: Column, labels: Column, ignored: int = -100) -> Column:
    """The losses of tokens whose label isn't the ignored one."""
    return F.transform(F.filter(F.arrays_zip(losses.alias("l"), labels.alias("y")), lambda x: x["y"] != ignored), lambda x: x["l"])


def response_window(tokens: Column, prompt_length: Column, most: int, prompt_only: bool = False) -> Column:
    """The tokens a loss is taken of: the response's first `most` (-1: all), or the prompt's."""
    if prompt_only:
        return F.slice(tokens, F.lit(1), prompt_length if most < 0 else F.least(prompt_length, F.lit(most)))
    rest = F.size(tokens) - prompt_length
    return F.slice(tokens, prompt_length + 1, F.greatest(rest if most < 0 else F.least(rest, F.lit(most)), F.lit(0)))


def nan_to_zero(column: Column) -> Column:
    return F.nanvl(column.cast("double"), F.lit(0.0))


def checkpoints_of(losses: DataFrame) -> list[int]:
    """The checkpoints that a table has; few."""
    return sorted(r[0] for r in losses.select("ckpt").distinct().collect())


def trajectories(losses: DataFrame, keys: tuple[str, ...] = ("sample_id",), checkpoints: list[int] | None = None) -> DataFrame:
    """keys, traj: the losses of each sample in order of checkpoint, NaN as 0.

    Every sample must have each of the checkpoints (of the table, if none are named) once; one that lacks some, or has one twice, is
    an error that names it, as its later losses would stand in the wrong places.
    """
    wanted = F.array(*(F.lit(c) for c in sorted(checkpoints if checkpoints is not None else checkpoints_of(losses)))).cast("array<int>")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ckpt").cast("int").alias("ckpt"), nan_to_zero(F.col("loss")).alias("loss"))))
    rows = losses.groupBy(*keys).agg(ordered.alias("__o"))
    found = F.transform("__o", lambda x: x["ckpt"])
    said = F.concat(F.lit("losses of "), F.to_json(F.struct(*keys)), F.lit(" at checkpoints "), F.to_json(found), F.lit(" instead of "), F.to_json(wanted))
    return rows.select(*keys, F.when(found == wanted, F.transform("__o", lambda x: x["loss"])).otherwise(F.raise_error(said).cast("array<double>")).alias("traj"))


def incomplete(losses: DataFrame, checkpoints: list[int], keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """keys, missing, repeated: the samples that don't have each of the checkpoints once."""
    wanted = F.array(*(F.lit(c) for c in sorted(checkpoints))).cast("array<int>")
    rows = losses.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("ckpt").cast("int"))).alias("__c"))
    missing = F.array_except(wanted, "__c")
    repeated = F.filter(F.array_distinct("__c"), lambda c: F.size(F.filter("__c", lambda x: x == c)) > 1)
    return rows.select(*keys, missing.alias("missing"), repeated.alias("repeated")).where((F.size("missing") > 0) | (F.size("repeated") > 0))


def loss_matrix(losses: DataFrame, checkpoints: list[int]) -> DataFrame:
    """A row for each sample, a column ckpt_N for each checkpoint, NaN as 0; each sample must have them all."""
    wide = trajectories(losses.where(F.col("ckpt").isin(checkpoints)), checkpoints=checkpoints)
    places = {c: i for i, c in enumerate(sorted(checkpoints))}
    return wide.select("sample_id", *(F.get("traj", F.lit(places[c])).alias(f"ckpt_{c}") for c in checkpoints))


def checkpoint_means(losses: DataFrame, low: float = 2.0, high: float = 3.0) -> DataFrame:
    """ckpt, mean_loss, ratio to the first checkpoint, and whether the ratio is in [low, high]."""
    means = losses.groupBy("ckpt").agg((F.sum("loss") / F.count("loss")).alias("mean_loss"))
    base = means.agg(F.min_by("mean_loss", "ckpt").alias("base"))  # one row
    ratio = F.when(F.col("base") > 0, F.col("mean_loss") / F.col("base")).otherwise(F.lit(float("inf")))
    return means.crossJoin(F.broadcast(base)).select("ckpt", "mean_loss", ratio.alias("ratio"), ratio.between(low, high).alias("in_range"))


def require_last_is_highest(losses: DataFrame) -> None:
    """An error unless the last checkpoint has the highest mean loss; of equal ones the first counts as highest."""
    means = sorted((r["ckpt"], r["m"]) for r in losses.groupBy("ckpt").agg(F.avg("loss").alias("m")).collect())
    _require_rise([m for _, m in means])


def require_rise(trajs: DataFrame, features: str = "traj") -> None:
    """The same for trajectories, whose values are in order of checkpoint."""
    width = trajs.agg(F.max(F.size(features))).first()[0]
    if width is not None:
        means = trajs.agg(*(F.avg(F.get(features, F.lit(i))).alias(f"m{i}") for i in range(width))).first()
        _require_rise(list(means) or [0.0])


def _require_rise(means: list[float]) -> None:
    if len(means) < 2:
        raise ValueError("at least two checkpoints are needed")
    if means.index(max(means)) != len(means) - 1:
        raise ValueError("the last checkpoint does not have the highest mean loss")


def length_faults(df: DataFrame, expected: str, losses: str = "losses") -> DataFrame:
    """The rows whose number of losses isn't the expected one; empty if all is well."""
    return df.where(F.coalesce(F.size(losses), F.lit(0)) != F.col(expected))


def loss_summary(losses: DataFrame) -> DataFrame:
    """min, max and the lower median of the losses."""
    return losses.agg(F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY loss)").alias("median_loss"))


# -- the surrogate provider --------------------------------------------------------------------------------


def words(text: Column, most: int | None = None) -> Column:
    """The words of a text, or its first `most`; of these no more than needed is split."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+", -1 if most is None else most + 2)
    found = F.filter(parts if most is None else F.slice(parts, 1, most + 1), lambda x: x != "")
    return found if most is None else F.slice(found, 1, most)


#: Words of at least one in so many tokens go out to all tasks; there can't be more of them than that.
FREQUENT = 20_000


def word_counts(samples: DataFrame) -> DataFrame:
    """word, n: how often the samples have each word."""
    return samples.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def information(n: Column, total: int) -> Column:
    """Of a word with n of the total, in millionths of a nat."""
    return F.round(-F.log(n.cast("double") / F.lit(total)) * 1e6).cast("long")


def tokens(samples: DataFrame, most: int | None = None) -> DataFrame:
    """sample_id, t, mn: a row for each of a sample's first `most` words (all by default), with its information in the whole corpus.

    Words are counted before they are shuffled. Frequent words, which no task could hold by themselves, meet their
    counts in a broadcast of FREQUENT rows at most; only rare words are shuffled.
    """
    counts = written(word_counts(samples))
    total = counts.agg(F.sum("n")).first()[0] or 1
    info = counts.select(F.col("word").alias("__word"), information(F.col("n"), total).alias("mn"), "n")
    often = F.col("n") * FREQUENT >= F.lit(total)
    rows = samples.select("sample_id", F.posexplode(words(F.col("text"), most)).alias("p", "word"))
    met = rows.join(F.broadcast(info.where(often)), F.col("word") == F.col("__word"), "left").drop("n")
    rare = met.where("mn IS NULL").drop("mn", "__word").join(info.where(~often), F.col("word") == F.col("__word")).select("sample_id", "p", "mn")
    return met.where("mn IS NOT NULL").select("sample_id", "p", "mn").unionByName(rare).select("sample_id", (F.col("p") + 1).alias("t"), "mn")


def token_loss(checkpoint: int, series: str = "perturbation", phase: str = PHASE) -> Column:
    return F.expr(f"mn * ({SERIES[series].format(j=checkpoint, phase=phase)}) div 1000")


def surrogate_losses(samples: DataFrame, checkpoints: list[int], series: str = "perturbation") -> DataFrame:
    """ckpt, loss: each token's loss at each checkpoint, in no order and without its sample, for figures over all tokens.

    As no sample's losses meet, only rare words are shuffled, each with the phases of its tokens in a byte apiece (of at most one token
    in FREQUENT), whose number is the word's count. Of the counts before that only frequent words' are kept.
    """
    spark = samples.sparkSession
    path = scratch_path(spark, "word-counts")
    counts = stored(word_counts(samples), path)
    total = counts.agg(F.sum("n")).first()[0] or 1
    often = written(counts.where(F.col("n") * FREQUENT >= F.lit(total)).select(F.col("word").alias("__word"), information(F.col("n"), total).alias("mn")))
    remove(spark, path)
    placed = samples.select("sample_id", F.posexplode(words(F.col("text"))).alias("p", "word")).select("sample_id", (F.col("p") + 1).alias("t"), "word")
    rows = placed.select("word", F.expr(PHASE).cast("byte").alias("phase"))
    known = rows.join(F.broadcast(often), F.col("word") == F.col("__word")).select("mn", "phase")
    rare = rows.join(F.broadcast(often.select("__word")), F.col("word") == F.col("__word"), "left_anti")
    phases = rare.groupBy("word").agg(F.collect_list("phase").alias("phases"))
    counted = phases.select(information(F.size("phases"), total).alias("mn"), F.explode("phases").alias("phase"))
    at = F.array(*(F.struct(F.lit(j).alias("ckpt"), token_loss(j, series, "phase").alias("loss")) for j in checkpoints))
    return known.unionByName(counted).select(F.explode(at).alias("x")).select("x.ckpt", "x.loss")


def surrogate_token_losses(samples: DataFrame, checkpoint: int, series: str = "perturbation", most: int | None = None) -> DataFrame:
    """sample_id, losses: the token losses of each sample in order; samples without words have an empty array."""
    rows = tokens(samples, most).select("sample_id", "t", token_loss(checkpoint, series).alias("loss"))
    arrays = rows.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "loss"))), lambda x: x["loss"]).alias("losses"))
    return samples.select("sample_id").join(arrays, "sample_id", "left").select("sample_id", F.coalesce("losses", F.array().cast("array<bigint>")).alias("losses"))


def surrogate_trajectories(samples: DataFrame, checkpoints: list[int], most: int = 100, series: str = "perturbation") -> DataFrame:
    """samples' columns but text, and traj: the mean loss over the first words at each checkpoint, whole numbers, 0 without words."""
    rows = tokens(samples, most)
    means = rows.groupBy("sample_id").agg(F.count("*").alias("n"), *(F.sum(token_loss(j, series)).alias(f"s{j}") for j in checkpoints))
    traj = F.array(*(F.expr(f"coalesce(s{j} div n, 0L)") for j in checkpoints))
    return samples.drop("text").join(means, "sample_id", "left").select(*(c for c in samples.columns if c != "text"), traj.alias("traj"))


def long_losses(trajs: DataFrame, checkpoints: list[int]) -> DataFrame:
    """sample_id, ckpt, loss."""
    pairs = F.arrays_zip(F.array(*(F.lit(c) for c in checkpoints)).alias("ckpt"), F.col("traj").alias("loss"))
    return trajs.select("sample_id", F.explode(pairs).alias("x")).select("sample_id", "x.ckpt", "x.loss")

