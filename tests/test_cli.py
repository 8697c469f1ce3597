"""The command line and the model boundaries, end to end on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tamis import cli
from tamis.operators import allocate, providers


@pytest.fixture
def files(spark, tmp_path):
    rng = random.Random(0)
    content = "<|im_start|>think\n{}\n<|im_start|>answer\nb\n<|im_end|>\n"
    rows = [(i, [("user", "q"), ("assistant", content.format("a" * rng.randint(1, 50)))], "q", f"d{i % 2}", f"s{i % 4}") for i in range(40)]
    spark.createDataFrame(rows, "sample_id long, conversations array<struct<role:string,content:string>>, prompt string, domain string, source string").write.parquet(str(tmp_path / "samples"))
    tokens = [(i, c, [c + rng.random() for _ in range(5)]) for i in range(40) for c in (1, 2, 3)]
    spark.createDataFrame(tokens, "sample_id long, ckpt int, losses array<double>").write.parquet(str(tmp_path / "tokens"))
    cli.main(["prefix-means", "--token-losses", str(tmp_path / "tokens"), "--output", str(tmp_path / "losses"), "--windows", "2", "-1"], spark)
    return tmp_path


@pytest.mark.parametrize("options", [["--method", "learnability", "--softmax"], ["--method", "high_loss_clusters", "--all-samples"], ["--method", "longest_reasoning"], ["--method", "random"], ["--method", "middle_perplexity", "--checkpoints", "2"]])
def test_select(spark, files, options):
    out = str(files / "out")
    cli.main(["select", "--samples", str(files / "samples"), "--losses", str(files / "losses"), "--window", "full", "--size", "12", "--output", out, "--niter", "3", *options], spark)
    ids = [r.sample_id for r in spark.read.parquet(f"{out}/labeled_idx").collect()]
    assert spark.read.json(f"{out}/labeled").count() == len(ids) and (len(ids) == 12 or "--all-samples" in options)
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["select", "--samples", str(files / "samples"), "--size", "3", "--method", "random", "--output", out], spark)
    cli.main(["apply-subset", "--samples", str(files / "samples"), "--subset", f"{out}/labeled_idx", "--output", f"{out}/rest", "--complement"], spark)
    assert spark.read.json(f"{out}/rest").count() == 40 - len(ids)


def test_embeddings_need_no_losses(spark, files):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(40)]
    spark.createDataFrame(rows, "sample_id long, embedding array<double>").write.parquet(str(files / "emb" / "checkpoint-2"))
    common = ["select", "--samples", str(files / "samples"), "--method", "embedding", "--size", "6"]
    cli.main([*common, "--embeddings", str(files / "emb"), "--checkpoints", "2", "--output", str(files / "e")], spark)
    assert 1 <= spark.read.parquet(str(files / "e" / "labeled_idx")).count() <= 6
    with pytest.raises(SystemExit):
        cli.main([*common, "--output", str(files / "e2")], spark)


def test_budgets_from_other_losses_and_a_dump(spark, files):
    common = ["select", "--samples", str(files / "samples"), "--losses", str(files / "losses"), "--window", "full", "--method", "learnability", "--niter", "2"]
    cli.main([*common, "--softmax", "--size", "12", "--difficulty-window", "2", "--dump-losses", "--output", str(files / "d")], spark)
    assert spark.read.parquet(str(files / "d" / "labeled_idx")).count() == 12 and spark.read.parquet(str(files / "d" / "loss")).count() == 40
    cli.main([*common, "--sources", '{"s1": [2, 4], "other": [1, 1]}', "--output", str(files / "s")], spark)
    assert {r.source: r["count"] for r in spark.read.json(str(files / "s" / "labeled")).groupBy("source").count().collect()} == {"s0": 1, "s1": 4, "s2": 1, "s3": 1}


def test_config_files_give_way_to_options(spark, files):
    (files / "c.json").write_text(json.dumps({"method": "random", "size": 30}))
    cli.main(["select", "--samples", str(files / "samples"), "--config", str(files / "c.json"), "--size", "5", "--output", str(files / "o")], spark)
    assert spark.read.parquet(str(files / "o" / "labeled_idx")).count() == 5
    with pytest.raises(SystemExit):
        cli.main(["select", "--samples", str(files / "samples"), "--size", "5", "--output", str(files / "p")], spark)
    with pytest.raises(ValueError, match="3, 4|4"):
        cli.main(["select", "--samples", str(files / "samples"), "--losses", str(files / "losses"), "--window", "2", "--size", "5", "--checkpoints", "3-4", "--output", str(files / "p")], spark)


def test_convert_score_and_report(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"prompt": "p", "reasoning": "r", "distilled_answer_string": "a", "source": "s"}\n')
    cli.main(["convert", "--kind", "medical", "--input", str(tmp_path / "raw.jsonl"), "--output", str(tmp_path / "conv")], spark)
    assert spark.read.json(str(tmp_path / "conv")).collect()[0].domain == "medical"
    (tmp_path / "res.jsonl").write_text('{"extracted_answer": "B", "answer_idx": "B", "answer": "x", "source": "NEJM", "option_str": "A. y\\nB. x", "question": "q"}\n')
    cli.main(["score", "--results", str(tmp_path / "res.jsonl"), "--output", str(tmp_path / "sc")], spark)
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "metrics.json").write_text('{"NEJM": {"accuracy": 0.5}, "Lancet": 0.25}')
    cli.main(["report", "--root", str(tmp_path / "runs"), "--output", str(tmp_path / "rep")], spark)
    report = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "rep"))
    assert report.columns == ["run", "Lancet", "NEJM"] and report.collect()[0].NEJM == "0.5"


def echo():
    """A local class, which goes to the workers by value."""

    class Echo:
        """A model that says its prompt's length."""

        def losses(self, prompts, responses, most):
            return [[float(len(w)) for w in r.split()[: most if most >= 0 else None]] for r in responses]

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

        def generate(self, prompts, most):
            return [providers.Generation("thought ", "length" if m < 3 else "stop", min(m, 2)) for m in most]

        def count(self, text):
            return 1

    return Echo


def test_providers(spark):
    Echo = echo()  # noqa: N806
    df = spark.createDataFrame([(1, "p", "aa b ccc", "t")], "sample_id long, prompt string, response string, text string")
    assert providers.token_losses(df, Echo, 3, 2).collect()[0].losses == [2.0, 1.0]
    assert providers.embeddings(df, Echo).collect()[0].embedding == [1.0, 1.0]
    made = providers.responses(df.select(F.col("sample_id").alias("item_id"), "prompt"), Echo, providers.ThinkSettings(budget=9, times=2, overthink="stop now", answer="so")).collect()[0]
    assert made.thinking_text == "thought  Waitthought  Waitthought " and made.num_keep_think_below_budget == 2 and made.num_gen_tokens == 10
    with pytest.raises(ValueError):
        providers.think(type("Odd", (Echo,), {"generate": lambda self, p, m: [providers.Generation("", "abort", 0)] * len(p)})(), ["p"], providers.ThinkSettings(budget=5))


def test_contiguous_split():
    assert allocate.contiguous_split(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)] and allocate.contiguous_split(1, 3) == [(0, 1), (1, 1), (1, 1)]
    with pytest.raises(ValueError):
        allocate.contiguous_split(1, 0)


def test_settings_of_files_and_overrides(tmp_path):
    from tamis.plans.config import SelectionConfig, read_settings

    (tmp_path / "a.json").write_text('{"size": 5, "sources": {"web": [2, 10]}}')
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "list.json").write_text("[1]")
    path = str(tmp_path / "a.json")
    assert read_settings(path) == {"size": 5, "sources": {"web": (2, 10)}}
    assert read_settings(path, ["size=7", "sources.other=[1, 0]", "method=learnability"]) == {"size": 7, "method": "learnability", "sources": {"web": (2, 10), "other": (1, 0)}}
    assert read_settings(None) == {} and read_settings(None, ["softmax=true"]) == {"softmax": True}
    config = SelectionConfig(seed=1).merged(read_settings(path, ["seed=2", "niter=3"]))
    assert (config.seed, config.niter, config.sources) == (1, 3, {"web": (2, 10)})
    for bad in ("size", "=3", "sources..web=1", "size.x=3"):
        with pytest.raises(ValueError):
            read_settings(path, [bad])
    with pytest.raises(ValueError, match="by name"):
        read_settings(str(tmp_path / "list.json"))
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("size: 5\nsources:\n  web: [2, 10]\n")
    assert read_settings(str(tmp_path / "a.yaml"), ["sources.web=[3, 9]"]) == {"size": 5, "sources": {"web": (3, 9)}}
    assert read_settings(str(tmp_path / "empty.yaml")) == {}
