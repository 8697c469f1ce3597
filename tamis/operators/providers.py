"""Where models plug in: token losses, embeddings and generation.

A provider is made once in each Python worker by a factory, which is sent to the executors, and is then given
batches. The library brings no model; the surrogate in operators.losses needs none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LossProvider(Protocol):
    def losses(self, prompts: list[str], responses: list[str], most: int) -> list[list[float]]:
        """The losses of each response's first `most` tokens (-1: all)."""


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""


@dataclass(frozen=True)
class Generation:
    """A generated text, why it ended (stop or length), and its number of tokens."""

    text: str
    finish_reason: str
    tokens: int


class Generator(Protocol):
    def generate(self, prompts: list[str], most: list[int]) -> list[Generation]:
        """A continuation of each prompt, of at most so many tokens."""

    def count(self, text: str) -> int:
        """The number of tokens of a text."""


def token_losses(samples: DataFrame, factory: Callable[[], LossProvider], checkpoint: int, most: int = -1) -> DataFrame:
    """ckpt, sample_id, losses of samples (sample_id, prompt, response)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for batch in batches:
            made = provider.losses(batch["prompt"].tolist(), batch["response"].tolist(), most)
            yield pd.DataFrame({"ckpt": checkpoint, "sample_id": batch["sample_id"], "losses": made})

    return samples.select("sample_id", "prompt", "response").mapInPandas(run, "ckpt int, sample_id long, losses array<float>")


def embeddings(samples: DataFrame, factory: Callable[[], EmbeddingProvider]) -> DataFrame:
    """sample_id, embedding of samples (sample_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for batch in batches:
            yield pd.DataFrame({"sample_id": batch["sample_id"], "embedding": provider.embed(batch["text"].tolist())})

    return samples.select("sample_id", "text").mapInPandas(run, "sample_id long, embedding array<float>")


# -- scoring that goes on where it stopped -----------------------------------------------------------------

#: Characters that a model gets at once; a longer text goes alone.
BATCH_CHARS = 1 << 16
TOKEN_LOSSES = "ckpt int, sample_id long, losses array<float>"


def by_length(lengths: list[int], most: int = BATCH_CHARS) -> list[list[int]]:
    """Places in batches of like lengths whose sum, padded to the longest, is within `most`."""
    batches: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batches and (len(batches[-1]) + 1) * max(lengths[i], 1) <= most:
            batches[-1].append(i)
        else:
            batches.append([i])
    return batches


def stored_losses(spark: SparkSession, path: str) -> DataFrame:
    """The loss table of a folder, a row for each checkpoint and sample however often it was stored; empty if there is none yet."""
    try:
        return spark.read.schema(TOKEN_LOSSES).parquet(path).select("ckpt", "sample_id", "losses").dropDuplicates(["ckpt", "sample_id"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TOKEN_LOSSES)


def pending(samples: DataFrame, checkpoints: list[int], path: str) -> DataFrame:
    """ckpt and the samples that the loss table of a folder lacks at it."""
    wanted = samples.withColumn("ckpt", F.explode(F.array(*(F.lit(c) for c in checkpoints)))).withColumn("ckpt", F.col("ckpt").cast("int"))
    return wanted.join(stored_losses(samples.sparkSession, path).select("ckpt", "sample_id"), ["ckpt", "sample_id"], "left_anti")


def store_token_losses(samples: DataFrame, factory: Callable[[int], LossProvider], checkpoints: list[int], path: str, most: int = -1) -> dict[int, int]:
    """Scores what the loss table of a folder lacks of samples (sample_id, prompt, response), and adds it; the rows scored by checkpoint.

    A checkpoint's provider, factory(checkpoint), is made once a task, and only where samples are left. Finished checkpoints cost a look at
    their ids; a run that was cut off goes on with what it hadn't stored, as a checkpoint's rows become visible when they are all written. Texts of like
    lengths go to the model together.
    """
    scored: dict[int, int] = {}
    for checkpoint in sorted(checkpoints):
        left = pending(samples, [checkpoint], path)
        n = left.count()
        if n:

            def run(batches: Iterator[pd.DataFrame], checkpoint: int = checkpoint) -> Iterator[pd.DataFrame]:
                provider = None
                for batch in batches:
                    if len(batch):
                        provider = provider or factory(checkpoint)
                        prompts, responses = batch["prompt"].fillna("").tolist(), batch["response"].fillna("").tolist()
                        for at in by_length([len(p) + len(r) for p, r in zip(prompts, responses, strict=True)]):
                            made = provider.losses([prompts[i] for i in at], [responses[i] for i in at], most)
                            yield pd.DataFrame({"sample_id": batch["sample_id"].iloc[at].to_numpy(), "losses": made})

            rows = left.select("sample_id", "prompt", "response").mapInPandas(run, "sample_id long, losses array<float>")
            rows.write.mode("append").parquet(f"{path}/ckpt={checkpoint}")
            scored[checkpoint] = n
    return scored


@dataclass(frozen=True)
class ThinkSettings:
    """Token budget, how often to think on below it, and the texts for that and for the end of thinking."""

    budget: int
    times: int = 0
    word: str = "Wait"
    overthink: str = ""
    answer: str = ""
    answer_budget: int = 512


def think(model: Generator, prompts: list[str], settings: ThinkSettings) -> list[dict]:
    """Thinking, prolonged while there is budget, then an answer, for each prompt."""
    first = model.generate(prompts, [settings.budget] * len(prompts))
    state = [{"text": g.text, "reason": g.finish_reason, "used": g.tokens, "prolonged": 0} for g in first]
    for _ in range(settings.times):
        going = []
        for i, s in enumerate(state):
            word = f" {settings.word}" if s["text"].endswith(" ") else settings.word
            used = s["used"] + model.count(word)
            if s["used"] < settings.budget and used < settings.budget:
                s["text"], s["used"] = s["text"] + word, used
                going.append(i)
        if not going:
            break
        more = model.generate([prompts[i] + state[i]["text"] for i in going], [settings.budget - state[i]["used"] for i in going])
        for i, g in zip(going, more, strict=True):
            s = state[i]
            s.update(text=s["text"] + g.text, reason=g.finish_reason, used=s["used"] + g.tokens, prolonged=s["prolonged"] + 1)
    starts = []
    for s in state:
        if s["reason"] not in ("length", "stop"):
            raise ValueError(f"unknown finish reason {s['reason']!r}")
        lead = settings.overthink if s["reason"] == "length" else settings.answer
        starts.append(lead if not lead or lead.endswith("\n") else f"{lead}\n")
    answers = model.generate([p + s["text"] + lead for p, s, lead in zip(prompts, state, starts, strict=True)], [settings.answer_budget] * len(prompts))
    return [
        {"thinking_text": s["text"], "thinking_finish_reason": s["reason"], "response_text": g.text, "finish_reason": g.finish_reason, "num_gen_tokens": s["used"] + g.tokens, "num_keep_think_below_budget": s["prolonged"]}
        for s, g in zip(state, answers, strict=True)
    ]


def responses(items: DataFrame, factory: Callable[[], Generator], settings: ThinkSettings, prompt: str = "prompt", ident: str = "item_id") -> DataFrame:
    """ident and what think() gives for each prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            made = pd.DataFrame(think(model, batch[prompt].tolist(), settings))
            made.insert(0, ident, batch[ident].to_numpy())
            yield made

    kind = items.schema[ident].dataType.simpleString()
    schema = f"{ident} {kind}, thinking_text string, thinking_finish_reason string, response_text string, finish_reason string, num_gen_tokens long, num_keep_think_below_budget int"
    return items.select(ident, prompt).mapInPandas(run, schema)
