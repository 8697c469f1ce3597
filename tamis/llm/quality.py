"""Quality rules by weak supervision.

Each rule looks at one measure of a text and votes good (+), bad (-) or abstains (0): between its limits, and where
the text gives it too little to go by (few words, lines or letters, or a script that the measure isn't made for).
Nobody says how far a rule can be trusted: expectation-maximisation over the counts of all vote patterns of the
corpus estimates how often each rule votes good on good and on bad documents, and the share of good ones. An
abstention is no evidence. A document is kept if its posterior probability of being good reaches a threshold, so
that a single vote against what the others and their estimated accuracies say is overruled. A pattern table has
3 ** rules rows at most whatever the corpus, so it may go to the driver and out again.

Null texts have no words. Documents with few words or much repetition fail outright and don't take part in
the estimate. Very long texts are measured whole, in time that grows a little faster than their length (windows are
sorted). Repeated rows count as often as they stand; of ties in a measure none is special. An empty table gives an
empty result. Other columns pass through; earlier columns of the outputs' names are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.runtime import map_rows, stored, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset("the of and to in a is that for it with as was on der die und das von zu mit den nicht ist le la les de et des que un une est el los en y del se las por con para".encode().split())

#: Punctuation that may be all there is to a word.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A rule abstains below so many words, lines or ASCII letters, and script rules where fewer than this share of bytes are ASCII.
FROM_WORDS, FROM_MANY_WORDS, FROM_LINES, FROM_LETTERS, FROM_ASCII = 30, 100, 4, 50, 0.6
#: Words so short, and so often in a text, are taken for its function words, whatever its language.
SHORT_BYTES, OFTEN = 4, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
INF = math.inf
#: Rule name: (measure, limits within which it votes good, limits outside of which it votes bad). It abstains between them.
RULES: dict[str, tuple[str, tuple[float, float], tuple[float, float]]] = {
    "symbols": ("symbols per word", (0, 0.01), (0, 0.10)),
    "wordless": ("share of words without letters or digits", (0, 0.03), (0, 0.15)),
    "repetition": ("share of words in repeated windows", (0, 0.05), (0, 0.15)),
    "duplicate_lines": ("share of duplicate lines", (0, 0.10), (0, 0.25)),
    "capitals": ("share of capitals among ASCII letters", (0, 0.15), (0, 0.40)),
    "shouting": ("exclamation marks per word", (0, 0.05), (0, 0.20)),
    "stop_words": ("share of stop words, where there are any", (0.12, INF), (0.03, INF)),
    "function_words": ("share of short words that recur, in long texts", (0.12, INF), (0.04, INF)),
    "word_length": ("mean word length", (3.0, 6.8), (2.2, 9.0)),
    "vocabulary": ("share of different words, at 100 words", (0.65, INF), (0.30, INF)),
    "digits": ("share of digits among characters", (0, 0.08), (0, 0.20)),
}


def repeat_words(ids: np.ndarray, vocabulary: int, window: int = WINDOW) -> int:
    """The words inside windows that occur twice or more, the first included. ids: a number for each word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    bits = max(1, (vocabulary - 1).bit_length())
    if bits * window <= 63:
        key = np.zeros(n, np.int64)
        for i in range(window):
            key = key << bits | ids[i : n + i]
    else:  # windows numbered by growing them a word at a time
        key = ids[:n].astype(np.int64)
        for i in range(1, window):
            key = np.unique(key * vocabulary + ids[i : n + i], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS, and the measures of RULES in their order."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = len(text or "") - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(ids, len(number))
    counts = (n, chars, symbols, dup_lines, repeated)
    if not n:
        return counts, (math.nan,) * len(RULES)
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(letters[65:91].sum()), int(letters[97:123].sum()), int(letters[48:58].sum())
    latin = letters[:128].sum() >= FROM_ASCII * len(raw)
    stops = sum(map(STOP_WORDS.__contains__, raw.lower().split())) if latin else 0
    often = np.bincount(ids)
    wordless = int(often[[not w.strip(PUNCTUATION) for w in number]].sum())
    function = int(often[(often >= OFTEN) & np.fromiter((len(w) <= SHORT_BYTES and w.isalpha() for w in number), bool, len(number))].sum())
    # the share of different words falls with length (Heaps); n ** 0.2 brings it to that of a text of 100 words
    vocabulary = len(number) / n * (n / 100) ** 0.2
    given = lambda value, enough: value if enough else math.nan
    return counts, (
        symbols / n,
        wordless / n,
        repeated / n,
        given(dup_lines / max(len(lines), 1), len(lines) >= FROM_LINES),
        given(upper / max(upper + lower, 1), latin and upper + lower >= FROM_LETTERS),
        given(int(letters[33]) / n, n >= FROM_WORDS),
        given(stops / n, n >= FROM_WORDS and stops),
        given(function / n, n >= FROM_MANY_WORDS and latin),
        given(chars / n, latin),
        given(vocabulary, n >= FROM_WORDS),
        digits / max(chars, 1),
    )


def vote(value: float, good: tuple[float, float], fair: tuple[float, float]) -> int:
    """1 within the good limits, -1 outside the fair ones, else 0; limits belong to either vote, not to the gap."""
    if math.isnan(value):
        return 0
    return 1 if good[0] <= value <= good[1] else -1 if value <= fair[0] or value >= fair[1] else 0


def with_votes(df: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """df with the counts, base_failed, and votes: a string of one character for each rule, of + - 0."""
    limits = [(good, fair) for _, good, fair in RULES.values()]

    def start():
        def work(texts):
            rows = [measures(t) for t in texts]
            votes = ["".join("0+-"[vote(v, *limit)] for v, limit in zip(values, limits, strict=True)) for _, values in rows]
            return [*([c[i] for c, _ in rows] for i in range(len(COUNTS))), votes]

        return work

    fields = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("votes", T.StringType())]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return map_rows(df, [text], fields, start, [text] if drop_text else None).withColumn("base_failed", failed)


def fit(patterns: dict[str, int], rounds: int = 200, settled: float = 1e-9) -> dict[str, float]:
    """The posterior probability of good for each vote pattern, from its count.

    Two classes, in which rules vote independently; of each class its share and each rule's chance to vote good when it
    votes are estimated, with one made-up vote of either kind for each, so that no chance is 0 or 1. It starts from the share of
    good votes among a pattern's votes, which says which class is which; patterns without any vote get the share of
    good documents. Ends after so many rounds, or when no posterior moves by more than `settled`.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    count = np.array([patterns[p] for p in names], float)
    good, bad = (np.array([[c == sign for c in p] for p in names], float) for sign in "+-")  # pattern, rule
    votes = (good + bad).sum(1)
    start = np.where(votes > 0, good.sum(1) / np.maximum(votes, 1), 0.5)
    # a rule's bad vote starts out as strong as all good ones together, as most rules find no fault in most bad texts
    posterior = np.where(bad.sum(1) > 0, np.minimum(start, 1 - bad.sum(1) / (bad.sum(1) + 1)), start)
    for _ in range(rounds):
        mass = np.stack([posterior * count, (1 - posterior) * count])  # class, pattern
        share = (mass.sum(1) + 1) / (count.sum() + 2)
        chance = (mass @ good + 1) / (mass @ (good + bad) + 2)  # class, rule: to vote good when it votes
        log = np.log(share)[:, None] + np.log(chance) @ good.T + np.log(1 - chance) @ bad.T
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved <= settled:
            break
    return {p: float(x) for p, x in zip(names, posterior, strict=True)}


def judge(df: DataFrame, text: str = "text", threshold: float = 0.5, drop_text: bool = False) -> DataFrame:
    """df with the counts, base_failed, votes, p_good (null where the base failed) and kept.

    Texts are measured once: the votes are written before they are counted, with the texts unless drop_text is set.
    """
    voted = with_votes(df, text, drop_text)
    voted = written(voted) if drop_text else stored(voted, "votes")
    counted = voted.where("NOT base_failed").groupBy("votes").count().collect()  # 3 ** rules rows at most
    posterior = fit({r["votes"]: r["count"] for r in counted})
    table = df.sparkSession.createDataFrame(sorted(posterior.items()), "__votes string, p_good double")
    judged = voted.drop("p_good").join(F.broadcast(table), F.col("votes") == F.col("__votes"), "left").drop("__votes")
    p_good = F.when(~F.col("base_failed"), F.col("p_good"))
    return judged.withColumn("p_good", p_good).withColumn("kept", F.coalesce(p_good >= threshold, F.lit(False)))
