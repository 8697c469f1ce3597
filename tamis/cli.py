"""Command line: python -m tamis.cli select|prefix-means|convert|apply-subset|score|report."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import convert, losses, sample, score
from tamis.operators.common import written
from tamis.plans.config import SelectionConfig, read_settings
from tamis.plans.select import select
from tamis.sources import io


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tamis")
    commands = top.add_subparsers(dest="command", required=True)

    one = commands.add_parser("select", help="choose a subset of samples by their losses")
    one.add_argument("--samples", required=True)
    one.add_argument("--losses", help="table of sample_id, ckpt, window, loss")
    one.add_argument("--window", default="1000")
    one.add_argument("--difficulty-window", help="window of the losses that budgets by softmax are taken from")
    one.add_argument("--difficulty-losses", help="their table, if it is another one")
    one.add_argument("--embeddings", help="table of sample_id, embedding, or a folder of checkpoint-N folders")
    one.add_argument("--sources", help='JSON: {"source": [clusters, samples], "other": [1, 0]}')
    one.add_argument("--order", choices=("as_written", "improvement"))
    one.add_argument("--dump-losses", action="store_true", help="write the losses that were used beside the selection")
    one.add_argument("--subset", help="ids to choose from")
    one.add_argument("--output", required=True, help="must not exist")
    one.add_argument("--config", help="JSON or YAML file; explicit options win over it")
    one.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting that wins over the file's; dots lead into nested ones")
    one.add_argument("--method")
    one.add_argument("--checkpoints")
    for name in ("size", "n-clusters", "n-sample-per-cluster", "seed", "niter"):
        one.add_argument(f"--{name}", type=int)
    for name in ("softmax", "all-samples", "compat"):
        one.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    one.add_argument("--cluster-features", choices=("raw", "standardized"))

    two = commands.add_parser("prefix-means", help="token losses to mean losses of their first tokens")
    two.add_argument("--token-losses", required=True)
    two.add_argument("--output", required=True)
    two.add_argument("--windows", type=int, nargs="+", default=[100, 200, 300, 500, 1000, -1])

    three = commands.add_parser("convert", help="raw records to conversations")
    three.add_argument("--kind", choices=("medical", "math"), required=True)
    three.add_argument("--input", required=True)
    three.add_argument("--output", required=True)

    four = commands.add_parser("apply-subset", help="the samples of a subset, or those outside it")
    four.add_argument("--samples", required=True)
    four.add_argument("--subset", required=True)
    four.add_argument("--output", required=True)
    four.add_argument("--complement", action="store_true")

    five = commands.add_parser("score", help="score answers and report accuracy by source")
    five.add_argument("--results", required=True)
    five.add_argument("--output", required=True)

    six = commands.add_parser("report", help="accuracy of all runs below a folder, a column for each source")
    six.add_argument("--root", required=True)
    six.add_argument("--output", required=True)
    six.add_argument("--finished", help="suffix of files beside metrics that have been dealt with, such as .txt")
    six.add_argument("--order", choices=("medical", "math"), default="medical")
    return top


def trajectories_of(spark: SparkSession, args: argparse.Namespace, config: SelectionConfig, path: str, window: str) -> DataFrame:
    """sample_id, traj in millionths, of the checkpoints asked for."""
    table = io.read_losses(spark, path, window)
    table = losses.require_checkpoints(table, config.checkpoints) if config.checkpoints else table
    return losses.trajectories(table).select("sample_id", F.transform("traj", lambda x: F.round(x * 1e6).cast("long")).alias("traj"))


def run_select(spark: SparkSession, args: argparse.Namespace) -> None:
    given = {f.name: getattr(args, f.name) for f in fields(SelectionConfig)}
    given["sources"] = {k: tuple(v) for k, v in json.loads(args.sources).items()} if args.sources else None
    config = SelectionConfig(**given).merged(read_settings(args.config, args.set))
    samples = io.read_samples(spark, args.samples)
    if args.subset:
        samples = sample.apply_subset(samples, spark.read.parquet(args.subset))
    strata, difficulty = samples.select("sample_id", "domain", "source"), None
    pool = strata
    if config.method == "longest_reasoning":
        text = convert.message_text(F.struct(F.expr("conversations[1].content").alias("content"), F.lit(None).cast("string").alias("value")))
        pool = samples.select("sample_id", "domain", "source", convert.reasoning_length(text, F.col("sample_id")).alias("reasoning_length"))
    elif config.method == "embedding":
        if not args.embeddings:
            raise SystemExit("embedding needs --embeddings")
        pool = pool.join(io.read_embeddings(spark, args.embeddings, config.checkpoints), "sample_id")
    elif config.method != "random":
        if not args.losses:
            raise SystemExit(f"{config.method} needs --losses")
        pool = written(strata.join(trajectories_of(spark, args, config, args.losses, args.window), "sample_id"))
        if args.difficulty_losses or args.difficulty_window:
            difficulty = strata.join(trajectories_of(spark, args, config, args.difficulty_losses or args.losses, args.difficulty_window or args.window), "sample_id")
    result = select(pool, config, difficulty)
    chosen = written(result.selected.select("sample_id"))
    with io.staged(spark, args.output) as folder:
        io.write_subset(chosen, f"{folder}/labeled_idx")
        io.write_selected(samples, chosen, f"{folder}/labeled")
        if args.dump_losses and "traj" in pool.columns:
            io.write_loss_matrix(pool, f"{folder}/loss")
        if result.clusters is not None and "source" in result.clusters.columns:
            io.write_clusters(result.clusters.select(*(c for c in ("domain", "source", "sample_id", "cluster_id") if c in result.clusters.columns)), f"{folder}/clusters")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tamis {args.command}").getOrCreate()
    if args.command == "select":
        run_select(spark, args)
    elif args.command == "prefix-means":
        rows = losses.prefix_means(spark.read.parquet(args.token_losses), args.windows)
        names = [f"mean_{'full' if n < 0 else n}" for n in args.windows]
        long = rows.select("sample_id", "ckpt", F.explode(F.array(*(F.struct(F.lit(n.removeprefix("mean_")).alias("window"), F.col(n).alias("loss")) for n in names))).alias("x"))
        io.write_losses(long.select("sample_id", "ckpt", "x.*"), args.output)
    elif args.command == "convert":
        raw = io.read_samples(spark, args.input)
        made = convert.math_sample(raw) if args.kind == "math" else convert.reasoning_sample(raw, "medical", answer="distilled_answer_string").drop("reasoning", "distilled_answer_string")
        made.write.mode("errorifexists").json(args.output)
    elif args.command == "apply-subset":
        pick = sample.complement if args.complement else sample.apply_subset
        pick(io.read_samples(spark, args.samples), spark.read.parquet(args.subset)).write.mode("errorifexists").json(args.output)
    elif args.command == "score":
        scored = written(score.scored(io.read_samples(spark, args.results)))
        scored.write.mode("errorifexists").json(f"{args.output}/scored")
        io.write_metrics(score.accuracy(scored), f"{args.output}/metrics")
    else:
        found = io.find_metrics(spark, args.root, finished=args.finished).select("run", F.explode(score.accuracy_of_json(F.col("content"))).alias("source", "accuracy"))
        io.write_metrics(score.pivoted(found, order=score.MEDICAL_ORDER if args.order == "medical" else score.MATH_ORDER), args.output)


if __name__ == "__main__":
    main()
