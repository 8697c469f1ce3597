"""Tensors as tables (model, name, idx, value): schedules, distances, directions and perturbations."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.operators.common import broadcast_if_small, written


def perturbed(name: Column) -> Column:
    """Whether a parameter takes part: embeddings, by their name, don't."""
    return ~F.lower(name).contains("embed")


def lambda_schedule(n: int, final_radius: float, min_radius: float | None = None) -> list[tuple[int, float, float]]:
    """(checkpoint, radius, lambda): radii in equal steps, and step sizes that reach them along one direction with unit noise."""
    if final_radius <= 0:
        raise ValueError("the final radius must be positive")
    if min_radius is not None and not 0 <= min_radius <= final_radius:
        raise ValueError("the least radius must be between 0 and the final one")
    steps, total, before = [], 0.0, 0.0
    for j in range(1, n + 1):
        if min_radius is None:
            radius = j * final_radius / n
        else:
            radius = final_radius if n == 1 else min_radius + (j - 1) * (final_radius - min_radius) / (n - 1)
        step = (math.sqrt(total**2 + 2 * (radius**2 - before**2)) - total) / 2
        steps.append((j, radius, step))
        total, before = total + step, radius
    return steps


def gaussian_schedule(n: int, first: float, last: float) -> list[tuple[int, float]]:
    """(checkpoint, l2): deviations that grow by equal steps of their squares."""
    step = (last**2 - first**2) / (n - 1) if n > 1 else 0.0
    return [(i + 1, math.sqrt(first**2 + i * step)) for i in range(n)]


def schedule_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def paired(params: DataFrame, base: str, other: str) -> DataFrame:
    """name, idx, a, b: the elements that both models have, of parameters that take part."""
    own = params.where(perturbed(F.col("name")))
    a = own.where(F.col("model") == base).select("name", "idx", F.col("value").cast("double").alias("a"))
    b = own.where(F.col("model") == other).select("name", "idx", F.col("value").cast("double").alias("b"))
    return a.join(b, ["name", "idx"])


def distance(params: DataFrame, base: str, other: str, target: float | None = None) -> DataFrame:
    """One row: actual_distance, num_params, l2_per_sqrt_d, and the ratio to a target (infinite for one of 0 or less)."""
    sums = paired(params, base, other).agg(F.sqrt(F.sum((F.col("b") - F.col("a")) ** 2)).alias("actual_distance"), F.count("*").alias("num_params"))
    made = sums.withColumn("l2_per_sqrt_d", F.col("actual_distance") / F.sqrt("num_params"))
    if target is None:
        return made
    return made.withColumn("actual_over_target", F.col("actual_distance") / target if target > 0 else F.lit(float("inf")))


def direction(params: DataFrame, start: str, end: str) -> DataFrame:
    """name, idx, value, norm: end - start divided by its norm; a norm of 0 is an error."""
    steps = paired(params, start, end).select("name", "idx", (F.col("b") - F.col("a")).alias("d"))
    norm = steps.agg(F.sqrt(F.sum(F.col("d") ** 2)).alias("norm"))
    norm = norm.select(F.when(F.coalesce(F.col("norm"), F.lit(0.0)) == 0, F.raise_error(F.lit("the direction is zero")).cast("double")).otherwise(F.col("norm")).alias("norm"))
    return steps.crossJoin(F.broadcast(norm)).select("name", "idx", (F.col("d") / F.col("norm")).alias("value"), "norm")


def seed_of(seed: int, step: int, name: str) -> int:
    """A tensor's seed: 63 bits of the BLAKE2b digest of seed, step and name, little end first."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{step}:{name}".encode(), digest_size=8).digest(), "little") & ((1 << 63) - 1)


def with_tensor_seeds(params: DataFrame, seed: int, step: int, name: str = "tensor_seed") -> DataFrame:
    """params with the seed of each row's tensor; digests are made once a name."""

    @F.pandas_udf("long")
    def digest(names: pd.Series) -> pd.Series:
        return names.map(lambda n: seed_of(seed, step, n))

    seeds = written(params.select(F.col("name").alias("__name")).distinct().withColumn(name, digest("__name")))
    return params.join(broadcast_if_small(seeds, 256), F.col("name") == F.col("__name")).drop("__name")


def normal(*keys: Column) -> Column:
    """A standard normal number that depends on the keys only (Box and Muller): the same however rows are dealt."""
    uniform = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *keys), 11) + 0.5) * F.lit(2.0**-53)
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def gaussian_perturb(params: DataFrame, sigma: float, seed: int, step: int = 1) -> DataFrame:
    """params with noise of deviation sigma on the parameters that take part."""
    noise = normal(F.col("tensor_seed"), F.col("idx")) * sigma
    value = F.col("value").cast("double") + F.when(perturbed(F.col("name")), noise).otherwise(F.lit(0.0))
    return with_tensor_seeds(params, seed, step).select(*(value.alias(c) if c == "value" else c for c in params.columns))


def directional_step(params: DataFrame, unit: DataFrame, size: float, seed: int, step: int = 1) -> DataFrame:
    """params moved by size * (1 + noise) along a direction (name, idx, value)."""
    own = unit.select("name", "idx", F.col("value").alias("__d"))
    noise = normal(F.col("tensor_seed"), F.col("idx"))
    moved = with_tensor_seeds(params, seed, step).join(own, ["name", "idx"], "left")
    value = F.col("value").cast("double") + F.coalesce(F.lit(size) * (1 + noise) * F.col("__d"), F.lit(0.0))
    return moved.select(*(value.alias(c) if c == "value" else c for c in params.columns))


# -- in blocks ---------------------------------------------------------------------------------------------

#: Elements of a block.
BLOCK = 4_096


def blocked(params: DataFrame, size: int = BLOCK) -> DataFrame:
    """model, name, block, values: the elements of a tensor in arrays of `size`; a gap between elements is an error.

    For tables by element; a large model is better read into blocks in the first place, as what follows moves blocks only.
    """
    rows = params.groupBy("model", "name", F.expr(f"idx div {size}").alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("idx") % size).alias("i"), F.col("value").cast("double").alias("v")))).alias("__e"))
    dense = F.transform("__e", lambda e: e["i"]) == F.transform(F.sequence(F.lit(0), F.size("__e") - 1), lambda i: i.cast("long"))
    values = F.when(dense, F.transform("__e", lambda e: e["v"])).otherwise(F.raise_error(F.concat(F.lit("gaps in tensor "), "name")).cast("array<double>"))
    return rows.select("model", "name", "block", values.alias("values"))


def unblocked(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """model, name, idx, value of blocks."""
    return blocks.select("model", "name", "block", F.posexplode("values").alias("i", "value")).select("model", "name", (F.col("block") * size + F.col("i")).alias("idx"), "value")


def distances(blocks: DataFrame, base: str, targets: dict[str, float] | None = None) -> DataFrame:
    """model, actual_distance, num_params, l2_per_sqrt_d, actual_over_target of every other model against a base, in one pass.

    The blocks of one place of all models meet by a single shuffle of blocks, whatever the number of models; parameters that don't take part, and
    places that the base lacks, are left out. Blocks of unequal lengths are an error.
    """
    own = blocks.where(perturbed(F.col("name")))
    met = own.groupBy("name", "block").agg(F.max(F.when(F.col("model") == base, F.col("values"))).alias("a"), F.collect_list(F.when(F.col("model") != base, F.struct("model", "values"))).alias("others"))
    pairs = met.where("a IS NOT NULL").select("name", "a", F.explode("others").alias("o")).select("name", "a", "o.model", F.col("o.values").alias("b"))
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda t, x: t + x)
    checked = F.when(F.size("a") == F.size("b"), square).otherwise(F.raise_error(F.concat(F.lit("unequal blocks in tensor "), "name")).cast("double"))
    sums = pairs.select("model", checked.alias("square"), F.size("a").alias("n")).groupBy("model").agg(F.sqrt(F.sum("square")).alias("actual_distance"), F.sum("n").alias("num_params"))
    target = F.coalesce(*(F.when(F.col("model") == m, F.lit(float(t))) for m, t in targets.items())) if targets else F.lit(None).cast("double")
    ratio = F.when(target > 0, F.col("actual_distance") / target).when(target.isNotNull(), F.lit(float("inf")))
    return sums.select("model", "actual_distance", "num_params", (F.col("actual_distance") / F.sqrt("num_params")).alias("l2_per_sqrt_d"), ratio.alias("actual_over_target"))


def direction_blocks(blocks: DataFrame, start: str, end: str) -> DataFrame:
    """name, block, values, norm: end - start divided by its norm; a norm of 0 is an error."""
    own = blocks.where(perturbed(F.col("name")) & F.col("model").isin(start, end))
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("values")))
    steps = written(own.groupBy("name", "block").agg(of(start).alias("a"), of(end).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select("name", "block", F.zip_with("a", "b", lambda x, y: y - x).alias("d")))
    norm = steps.agg(F.sqrt(F.sum(F.aggregate("d", F.lit(0.0), lambda t, x: t + x * x))).alias("norm")).first()["norm"]
    if not norm:
        raise ValueError("the direction is zero")
    return steps.select("name", "block", F.transform("d", lambda x: x / F.lit(norm)).alias("values"), F.lit(norm).alias("norm"))


def _with_step_seeds(blocks: DataFrame, seed: int, steps: int) -> DataFrame:
    """blocks with seeds, those of their tensor at each step."""

    @F.pandas_udf("array<bigint>")
    def digests(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [seed_of(seed, j + 1, n) for j in range(steps)])

    seeds = written(blocks.select(F.col("name").alias("__name")).distinct().withColumn("seeds", digests("__name")))
    return blocks.join(broadcast_if_small(seeds, 256 + 8 * steps), F.col("name") == F.col("__name")).drop("__name")


def gaussian_blocks(blocks: DataFrame, sigma: float, seed: int, step: int = 1, size: int = BLOCK) -> DataFrame:
    """gaussian_perturb() of blocks: the same noise for the same element."""
    noisy = F.transform("values", lambda v, i: v + normal(F.col("tensor_seed"), F.col("block") * size + i) * sigma)
    return with_tensor_seeds(blocks, seed, step).select("model", "name", "block", F.when(perturbed(F.col("name")), noisy).otherwise(F.col("values")).alias("values"))


def directional_checkpoints(base: DataFrame, unit: DataFrame, schedule: list[tuple[int, float, float]], seed: int, size: int = BLOCK) -> DataFrame:
    """model (checkpoint-N), name, block, values: every checkpoint of a schedule (lambda_schedule()) from the base's blocks, each by itself.

    A checkpoint is the base with the steps up to it, lambda * (1 + noise) along the direction. Base and direction meet once, for all of them.
    """
    own = unit.select(F.col("name").alias("__n"), F.col("block").alias("__b"), F.col("values").alias("__d"))
    rows = _with_step_seeds(base, seed, len(schedule)).join(own, (F.col("name") == F.col("__n")) & (F.col("block") == F.col("__b")), "left")
    steps = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(lam).alias("lam")) for j, _, lam in schedule))
    rows = rows.withColumn("__to", F.explode(F.array(*(F.lit(j) for j, _, _ in schedule))))

    def moved(v: Column, i: Column) -> Column:
        scale = F.aggregate(F.filter(F.arrays_zip(steps.alias("s"), F.col("seeds").alias("seed")), lambda x: x["s"]["j"] <= F.col("__to")), F.lit(0.0), lambda t, x: t + x["s"]["lam"] * (1 + normal(x["seed"], F.col("block") * size + i)))
        return v + F.coalesce(scale * F.get("__d", i), F.lit(0.0))

    return rows.select(F.concat(F.lit("checkpoint-"), F.col("__to").cast("string")).alias("model"), "name", "block", F.transform("values", moved).alias("values"))


def run_metadata(spark: SparkSession, lambdas: list[float], radii: list[float], **settings) -> DataFrame:
    """One row that tells a perturbation run's settings, steps and radii, for a sidecar."""
    kinds = {str: "string", bool: "boolean", int: "long", float: "double"}
    schema = ", ".join([*(f"`{k}` {kinds[type(v)]}" for k, v in settings.items()), "num_checkpoints int, lambdas array<double>, target_radii array<double>"])
    return spark.createDataFrame([(*settings.values(), len(lambdas), [float(x) for x in lambdas], [float(x) for x in radii])], schema)


def checkpoint_metrics(losses: DataFrame, distances: DataFrame) -> DataFrame:
    """checkpoint with loss and tokens (of weighted_loss) and what distance() gives, for the sidecars of each checkpoint."""
    return losses.withColumnRenamed("ckpt", "checkpoint").join(distances, "checkpoint", "left")


def weighted_loss(losses: DataFrame) -> DataFrame:
    """ckpt, loss, tokens: the mean over finite token losses, 0 without any. They are given in arrays (losses) or one to a row (loss); whole ones are summed as such."""
    tokens = losses.select("ckpt", F.col("loss").alias("x") if "loss" in losses.columns else F.explode_outer("losses").alias("x"))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    x = F.col("x") if isinstance(tokens.schema["x"].dataType, T.IntegralType) else F.col("x").cast("double")
    sums = tokens.groupBy("ckpt").agg(F.coalesce(F.sum(F.when(finite, x)).cast("double"), F.lit(0.0)).alias("s"), F.count(F.when(finite, 1)).alias("tokens"))
    return sums.select("ckpt", (F.col("s") / F.greatest("tokens", F.lit(1))).alias("loss"), "tokens")


def against_base(means: DataFrame, base: str | int) -> DataFrame:
    """means, which are made once, with delta and ratio to a base checkpoint (ratio infinite for a base of 0 or less)."""
    means = written(means)
    one = means.where(F.col("ckpt") == base).select(F.col("loss").alias("__base"))
    ratio = F.when(F.col("__base") > 0, F.col("loss") / F.col("__base")).otherwise(F.lit(float("inf")))
    return means.crossJoin(F.broadcast(one)).select(*means.columns, (F.col("loss") - F.col("__base")).alias("delta"), ratio.alias("ratio"))
