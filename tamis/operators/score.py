"""Scoring of answers, accuracy by source, and its pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.answers import with_choice

#: The order of the columns in reports.
MEDICAL_ORDER = ("MedMCQA_validation", "MedQA_USLME_test", "PubMedQA_test", "MMLU-Pro_Medical_test", "GPQA_Medical_test", "Lancet", "MedBullets_op4", "MedBullets_op5", "MedXpertQA", "NEJM")
MATH_ORDER = ("AMC23", "AIME24", "AIME25", "MATH500")


def exact_match(extracted: Column, letter: Column, answer: Column) -> Column:
    """Whether a text is the answer, "letter. answer" or the single letter, in any case."""
    text = F.lower(extracted)
    return (text == F.lower(answer)) | (text == F.lower(F.concat(letter, F.lit(". "), answer))) | ((F.length(extracted) == 1) & (text == F.lower(letter)))


def scored(results: DataFrame) -> DataFrame:
    """correct, extracted_answer, answer, source, option_str, question, matched_letter.

    The option is matched only where the exact rules fail, and by similarity only where the strict ones do too; a conditional
    would not keep Python from running on the other rows, so they are given null texts, which cost nothing.
    """
    exact = F.coalesce(exact_match(F.col("extracted_answer"), F.col("answer_idx"), F.col("answer")), F.lit(False))
    rows = results.withColumn("__exact", exact)
    asked = [F.when(~F.col("__exact"), F.col(c)) for c in ("extracted_answer", "option_str")]
    rows = with_choice(rows, *asked, "matched_letter")
    correct = F.col("__exact") | F.coalesce(F.lower("matched_letter") == F.lower("answer_idx"), F.lit(False))
    return rows.select(correct.alias("correct"), "extracted_answer", "answer", "source", "option_str", "question", "matched_letter")


def accuracy(df: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """by, correct_count, total_count, accuracy."""
    counts = df.groupBy(*by).agg(F.sum(F.col("correct").cast("long")).alias("correct_count"), F.count("*").alias("total_count"))
    return counts.withColumn("accuracy", F.col("correct_count") / F.col("total_count"))


def pivoted(metrics: DataFrame, run: str = "run", order: tuple[str, ...] = MEDICAL_ORDER) -> DataFrame:
    """A row for each run, a column for each source: the known ones in order, others after them by name, absent ones left out."""
    there = {r[0] for r in metrics.where("accuracy IS NOT NULL").select("source").distinct().collect()}
    columns = [c for c in order if c in there] + sorted(there - set(order))
    return metrics.groupBy(run).pivot("source", columns).agg(F.first("accuracy"))


def macro_average(metrics: DataFrame, by: str = "run") -> DataFrame:
    """The mean accuracy over sources."""
    return metrics.groupBy(by).agg(F.avg("accuracy").alias("macro_accuracy"))


def accuracy_of_json(text: Column) -> Column:
    """source to accuracy out of a metrics document: {source: {accuracy}}, {source: number} or {results: {set: {accuracy or accuracy_avg}}}."""
    body = F.coalesce(F.get_json_object(text, "$.results"), text)
    raw = F.from_json(body, "map<string,string>")
    value = lambda _, v: F.coalesce(F.get_json_object(v, "$.accuracy").cast("double"), F.get_json_object(v, "$.accuracy_avg").cast("double"), F.when(v.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), v.cast("double")))
    return F.transform_values(raw, value)
