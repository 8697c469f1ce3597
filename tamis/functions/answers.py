"""Answers in responses: the boxed part, and the option that a response means.

boxed() and strict_choice() are column expressions: a fold over the places of braces, and patterns whose classes of characters are those of
the plain forms below, which tests compare them with. Only the option most like a response that names none takes Python: a similarity without a
SQL form, in a pandas UDF that skips what upper bounds rule out. For spark.sql there are extract_answer, match_choice and closest_option.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The letters of options, and what may stand around a letter that is meant as an answer.
LETTERS = "ABCDEFGHIJKLMN"
FINAL_MARK = "## Final Response\n\n"
STATED = re.compile(r"answer is\s*?([A-N])", re.S)
#: The Han ideographs of the basic block.
HAN = "\\u4e00-\\u9fff"


@lru_cache(maxsize=32)
def delimited(n: int) -> re.Pattern | None:
    """One of the first n letters between delimiters; not the article "A " at the start of words."""
    # after the start, an ideograph, "is " or whatever is no part of a word; before an ideograph, no part of a word, or the end
    return re.compile(rf"(?:^|is |[{HAN}]|\W)(?![aA] )([{LETTERS[:n]}])(?:[{HAN}]|\W|$)", re.S) if n else None


def last_box(text: str) -> str:
    r"""The last \boxed (or else \fbox) with its balanced braces; the whole text if there is none or it isn't closed."""
    start = text.rfind("\\boxed")
    if start < 0:
        start = text.rfind("\\fbox")
    if start < 0:
        return text
    depth = 0
    for brace in re.finditer(r"[{}]", text[start:]):
        depth += 1 if brace.group() == "{" else -1
        if brace.group() == "}" and depth == 0:
            return text[start : start + brace.end()]
    return text


def unwrap(text: str, command: str) -> str:
    """What a command's braces hold, if text is just that; after its last equals sign if there is one."""
    head = f"{command}{{"
    if not (text.startswith(head) and text.endswith("}")):
        return text
    content = text[len(head) : -1]
    return content.rpartition("=")[2].lstrip(" ") if "=" in content else content


def boxed_answer(text: str | None) -> str | None:
    r"""The content of the last \boxed, also out of \text."""
    if text is None:
        return None
    return unwrap(last_box(unwrap(last_box(text), "\\boxed")), "\\text")


def parse_options(lines: str) -> dict[str, str]:
    """Lines "letter. text"."""
    return {head: rest for head, mark, rest in (line.strip().partition(". ") for line in lines.split("\n")) if mark}


def closest(options: list[str], target: str) -> int:
    """The index of the most similar option, of equal ones the last.

    Exact, though most options are never compared in full, which takes time with the square of the lengths: those of the highest upper bound
    (by lengths, then by counts of characters) come first, and one whose bound can't reach the best so far is left out.
    """
    matcher = difflib.SequenceMatcher(None, "", target)  # what is known of the target is kept from option to option
    bounds = []
    for i, option in enumerate(options):
        matcher.set_seq1(option)
        bounds.append((matcher.real_quick_ratio(), i))
    best = (-1.0, -1)
    for bound, i in sorted(bounds, reverse=True):
        if (bound, i) < best:
            continue
        matcher.set_seq1(options[i])
        if (matcher.quick_ratio(), i) >= best:
            best = max(best, (matcher.ratio(), i))
    return best[1]


@lru_cache(maxsize=4096)
def closest_letter(target: str | None, lines: str | None) -> str | None:
    """The letter of the option most like a text, of lines of options; pairs met lately are remembered."""
    parsed = parse_options(lines or "")
    letters = list(parsed)
    return letters[closest([parsed[x].lower() for x in letters], (target or "").lower())] if letters else None


def chosen_letter(text: str | None, option_lines: str | None) -> str | None:
    """The letter that a response means: stated, delimited, the option named last, or the most similar one."""
    if text is None or option_lines is None:
        return None
    options = parse_options(option_lines)
    text = text.rpartition(FINAL_MARK)[2]
    if stated := STATED.findall(text):
        return stated[-1]
    pattern = delimited(min(len(options), len(LETTERS)))
    if pattern and (found := pattern.findall(text)):
        return found[-1]
    if not options:
        return None
    text = text.lower()
    places = {letter: text.rfind(option.lower()) for letter, option in options.items()}
    best = max(places.values())
    if best >= 0:
        return next(letter for letter, place in places.items() if place == best)
    letters = list(options)
    return letters[closest([options[x].lower() for x in letters], text)]


@F.pandas_udf(T.StringType())
def extract_answer(text: pd.Series) -> pd.Series:
    return text.map(boxed_answer, na_action="ignore")


@F.pandas_udf(T.StringType())
def match_choice(text: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([chosen_letter(t, o) for t, o in zip(text, options, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def closest_option(text: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([closest_letter(t, o) for t, o in zip(text, options, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _closest_of_rest(text: pd.Series, options: pd.Series) -> pd.Series:
    """As closest_option, but null for null texts: rows that have their letter already."""
    return pd.Series([None if t is None else closest_letter(t, o) for t, o in zip(text, options, strict=True)], dtype=object)


# -- the same as column expressions ------------------------------------------------------------------------

#: Python's white space beyond Java's, and its letters, digits and underscore.
_SPACE, _WORD = r"\s\x1c-\x1f", r"\p{L}\p{N}_"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _after_last(text: Column, mark: Column) -> Column:
    """What follows the last mark, the whole text without one."""
    return F.call_function("substring_index", text, mark, F.lit(-1))


def _last_box(text: Column) -> Column:
    def from_mark(mark: str) -> Column:
        return F.when(F.contains(text, F.lit(mark)), F.concat(F.lit(mark), _after_last(text, F.lit(mark))))

    def closed(tail: Column) -> Column:
        braces = F.regexp_extract_all(tail, F.lit("[{}]"), F.lit(0))
        steps = F.zip_with(F.split(tail, "[{}]", -1), braces, lambda piece, brace: F.struct((F.length(piece) + 1).alias("step"), (brace == "{").alias("opens")))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

        def fold(x: Column, brace: Column) -> Column:
            depth, at = x["depth"] + F.when(brace["opens"], 1).when(~brace["opens"], -1).otherwise(0), x["at"] + brace["step"]
            return F.struct(depth.alias("depth"), at.alias("at"), F.coalesce(x["end"], F.when(~brace["opens"] & (depth == 0), at)).alias("end"))

        return F.substring(tail, F.lit(1), F.aggregate(steps, start, fold)["end"])

    return F.coalesce(_let(F.coalesce(from_mark("\\boxed"), from_mark("\\fbox")), closed), text)


def _unwrap(text: Column, command: str) -> Column:
    head = command + "{"

    def unwrapped(text: Column) -> Column:
        content = F.substring(text, F.lit(len(head) + 1), F.length(text) - len(head) - 1)
        inside = F.startswith(text, F.lit(head)) & F.endswith(text, F.lit("}"))
        return F.when(inside, _let(content, lambda x: F.when(F.contains(x, F.lit("=")), F.ltrim(_after_last(x, F.lit("=")))).otherwise(x))).otherwise(text)

    return _let(text, unwrapped)


def boxed(text: Column) -> Column:
    r"""The content of the last \boxed, also out of \text, braces balanced: boxed_answer() as an expression."""
    return _let(_unwrap(_let(text, _last_box), "\\boxed"), lambda x: _unwrap(_last_box(x), "\\text"))


def options_of(lines: Column) -> Column:
    """Lines "letter. text" as an array of letter and text, a letter once: where it came first, with the text that came last."""
    strip = lambda x: F.regexp_replace(x, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")
    parts = F.filter(F.transform(F.split(lines, "\n"), lambda x: F.split(strip(x), r"\. ", 2)), lambda p: F.size(p) == 2)
    named = lambda parts: F.transform(F.array_distinct(F.transform(parts, lambda p: p[0])), lambda x: F.struct(x.alias("letter"), F.element_at(F.filter(parts, lambda p: p[0] == x), -1)[1].alias("text")))
    return _let(parts, named)


def strict_choice(text: Column, lines: Column) -> Column:
    """The letter that a response states, delimits, or whose option it names last; null if it does none of these. No Python runs."""
    last = lambda found: F.get(found, F.size(found) - 1)

    def of(x: Column) -> Column:
        text, options = x["text"], x["options"]
        stated = F.regexp_extract_all(text, F.lit(rf"(?sU)answer is[{_SPACE}]*?([A-N])"), F.lit(1))
        letters = F.substring(F.lit(LETTERS), F.lit(1), F.least(F.size(options), F.lit(len(LETTERS))))
        pattern = F.concat(F.lit(rf"(?s)(?:^|is |[{HAN}]|[^{_WORD}])(?![aA] )(["), letters, F.lit(rf"])(?:[{HAN}]|[^{_WORD}]|$)"))
        bounded = F.when(F.size(options) > 0, F.regexp_extract_all(text, pattern, F.lit(1)))
        return F.coalesce(_let(stated, last), _let(bounded, last), named(F.lower(text), options))

    def named(low: Column, options: Column) -> Column:
        def place(o: Column, i: Column) -> Column:
            option = F.lower(o["text"])
            at = F.length(o["low"]) - F.length(_after_last(o["low"], option)) - F.length(option)
            return F.when(F.contains(o["low"], option), F.struct(at.alias("place"), (-i).alias("i"), o["letter"].alias("letter")))

        rows = _let(low, lambda low: F.transform(F.transform(options, lambda o: F.struct(o["letter"].alias("letter"), o["text"].alias("text"), low.alias("low"))), place))
        return F.array_max(rows)["letter"]

    both = F.struct(_after_last(text, F.lit(FINAL_MARK)).alias("text"), options_of(lines).alias("options"))
    return F.when(text.isNotNull() & lines.isNotNull(), _let(both, of))


def with_choice(df: DataFrame, text: Column, lines: Column, name: str) -> DataFrame:
    """df with the letter that a response means: strictly, or else that of the most similar option; what chosen_letter() gives.

    Only texts without a strict letter go to Python.
    """
    rest = F.when(lines.isNotNull() & F.col("__strict").isNull(), _after_last(text, F.lit(FINAL_MARK)))
    rows = df.select("*", strict_choice(text, lines).alias("__strict")).select("*", rest.alias("__rest"), lines.alias("__lines"))
    rows = rows.select("*", _closest_of_rest("__rest", "__lines").alias("__closest"))
    return rows.select(*(c for c in df.columns if c != name), F.coalesce("__strict", "__closest").alias(name))


def register(spark: SparkSession) -> None:
    """The three functions for SQL text."""
    for name, function in (("extract_answer", extract_answer), ("match_choice", match_choice), ("closest_option", closest_option)):
        spark.udf.register(name, function)
