"""Raw records to conversations, and the text parts of prompts and reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks between reasoning and answer in training samples.
THINK, ANSWER, END = "<|im_start|>think", "<|im_start|>answer", "<|im_end|>"
BEGIN_OF_THOUGHT, END_OF_THOUGHT = "<|begin_of_thought|>", "<|end_of_thought|>"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, "^[\\s\\x0B\\x1C-\\x1F]+", ""), "[\\s\\x0B\\x1C-\\x1F]+$", "")


def turn(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def reasoning_sample(df: DataFrame, domain: str, prompt: str = "prompt", reasoning: str = "reasoning", answer: str = "answer") -> DataFrame:
    """df with conversations, prompt and domain; a record without reasoning or answer is an error."""
    given = lambda c, what: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.raise_error(F.lit(f"a record has no {what}"))).otherwise(F.col(c))
    content = F.concat(F.lit(f"{THINK}\n"), strip(given(reasoning, "reasoning")), F.lit(f"\n{ANSWER}\n"), strip(given(answer, "answer")), F.lit(f"\n{END}\n"))
    return df.withColumn("conversations", F.array(turn("user", F.col(prompt)), turn("assistant", content))).withColumn("domain", F.lit(domain))


def normalize_turns(conversations: Column) -> Column:
    """Turns of role and content, or of from and value with human and gpt as user and assistant; null turns go."""
    names = lambda r: F.when(r.isin("human", "user"), "user").when(r.isin("gpt", "assistant"), "assistant").otherwise(r)
    both = lambda m: m["role"].isNotNull() & m["content"].isNotNull()
    return F.transform(F.filter(conversations, lambda m: m.isNotNull()), lambda m: turn(F.when(both(m), m["role"]).otherwise(names(m["from"])), F.when(both(m), m["content"]).otherwise(m["value"])))


def math_sample(df: DataFrame) -> DataFrame:
    """Correct records only, with prompt or else problem as prompt, turns normalised, domain math."""
    need = lambda c, what: F.when(c.isNull(), F.raise_error(F.lit(f"a record has no {what}"))).otherwise(c)
    kept = df.where(F.coalesce(F.col("correct"), F.lit(False)))
    return kept.withColumn("prompt", need(F.coalesce("prompt", "problem"), "prompt")).withColumn("conversations", normalize_turns(need(F.col("conversations"), "conversations"))).withColumn("domain", F.lit("math"))


def message_text(message: Column) -> Column:
    return F.coalesce(message["content"], message["value"])


def chat_text(system: str, prompt: Column, response: Column, eos: str = END) -> Column:
    """Prompt, response and end mark in a simple chat template."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}{END}\n<|im_start|>user\n"), prompt, F.lit(f"{END}\n<|im_start|>assistant\n"), response, F.lit(eos))


def training_texts(df: DataFrame, system: str, eos: str = END) -> DataFrame:
    """df with prompt_text and full_text, from whichever of these columns it has: conversations of two turns (content or
    value), prompt (a text, or turns) and completion (turns), text (without a prompt), or prompt and reasoning."""
    ask = lambda prompt: chat_text(system, prompt, F.lit(""), "")
    kinds = dict(df.dtypes)
    if "conversations" in kinds:
        first, second = F.col("conversations")[0], F.col("conversations")[1]
        said = lambda m: message_text(m) if "value:" in kinds["conversations"] and "content:" in kinds["conversations"] else m["value"] if "value:" in kinds["conversations"] else m["content"]
        prompt, response = ask(said(first)), said(second)
    elif "text" in kinds:
        prompt, response, eos = F.lit(""), F.col("text"), ""
    elif "prompt" in kinds and "completion" in kinds:
        turns = F.transform("prompt", lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit(f"{END}\n"))) if kinds["prompt"].startswith("array") else None
        prompt = ask(F.col("prompt")) if turns is None else F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))
        response = F.col("completion")[0]["content"]
    elif "prompt" in kinds and "reasoning" in kinds:
        prompt, response = ask(F.col("prompt")), F.col("reasoning")
    else:
        raise ValueError("no conversations, text, completion or reasoning to train on")
    return df.withColumn("full_text", F.concat(prompt, response, F.lit(eos))).withColumn("prompt_text", prompt)


def conversations_of(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """A row for each conversation, its turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content"))))
    return turns.groupBy(conversation).agg(F.transform(ordered, lambda x: turn(x["role"], x["content"])).alias("conversations"))


def two_turns(df: DataFrame) -> DataFrame:
    """The conversations of exactly two turns."""
    return df.where(F.size("conversations") == 2)


def reasoning_length(text: Column, label: Column) -> Column:
    """Characters of the reasoning and answer between the marks, or of the thought; other texts are an error naming the label."""
    fault = lambda what: F.raise_error(F.concat(F.lit(f"{what}: sample "), label.cast("string"))).cast("int")
    start = F.instr(text, THINK)
    rest = F.substring(text, start + len(THINK), F.length(text))
    mark = F.instr(rest, ANSWER)
    tail = F.substring(rest, mark + len(ANSWER), F.length(rest))
    stop = F.instr(tail, END)
    first = (mark - 1) + F.when(stop > 0, stop - 1).otherwise(F.length(tail))
    begin = F.instr(text, BEGIN_OF_THOUGHT)
    inner = F.substring(text, begin + len(BEGIN_OF_THOUGHT), F.length(text))
    close = F.instr(inner, END_OF_THOUGHT)
    return F.when(start > 0, F.when(mark > 0, first).otherwise(fault("no answer after the reasoning"))).when((begin > 0) & (close > 0), close - 1).otherwise(fault("no reasoning found"))


def option_string(options: Column) -> Column:
    """A line "letter. text" for each option."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(". "), o["text"])), "\n")


def parse_options(text: Column) -> Column:
    """Lines "letter. text" as an array of letter and text; other lines are left out."""
    lines = F.transform(F.split(strip(text), "\n"), lambda x: F.split(strip(x), "\\. ", 2))
    return F.transform(F.filter(lines, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("letter"), p[1].alias("text")))


def question_prompt(question: Column, options: Column, prefix: str | None = None, suffix: str | None = None, delimiter: str = "\n") -> Column:
    parts = [F.lit(prefix)] if prefix else []
    return F.concat_ws(delimiter, *parts, F.concat(question, F.lit("\n"), option_string(options)), *([F.lit(suffix)] if suffix else []))


def truncated_prompt(prompt: Column, tokens: Column, most: int) -> Column:
    """The prompt, or where it has more tokens than `most` its last `most` characters, as the evaluation does it."""
    return F.when(F.size(tokens) > most, F.substring(prompt, -most, most)).otherwise(prompt)


def continuation(text: Column, word: str = "Wait") -> Column:
    """The text with a word to think on; one more space before it where the text ends with a space."""
    return F.concat(text, F.when(F.substring(text, -1, 1) == " ", F.lit(f" {word}")).otherwise(F.lit(word)))


def end_prefix(finish_reason: Column, overthink: str, answer: str) -> Column:
    """What ends the reasoning: one text if it ran out of tokens, another if it stopped; both end with a new line."""
    ended = lambda s: F.lit(s if s.endswith("\n") else f"{s}\n")
    return F.when(finish_reason == "length", ended(overthink)).when(finish_reason == "stop", ended(answer)).otherwise(F.raise_error(F.concat(F.lit("unknown finish reason "), F.coalesce(finish_reason, F.lit("null")))))
