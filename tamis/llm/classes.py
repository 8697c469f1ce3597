"""Splitting patterns with the character classes of the tokenizer libraries.

Classes such as letters belong to a version of Unicode, and the libraries' isn't that of Python's own tables. So the
members of a class are asked of a library itself, once a process, and the pattern is spelled out in ranges of code
points for the standard library's engine: one form for ASCII texts, one for texts of the first plane, one for all.
"""

from __future__ import annotations

import re
from functools import cache

import regex
import tiktoken

LAST, PLANE = 0x10FFFF, 0xFFFF
EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, LAST + 1)]))
#: Escapes that stand for a class, as their Unicode property.
SHORT = {"s": r"\s", "d": r"\p{Nd}"}
BEYOND = re.compile(f"[{chr(PLANE + 1)}-{chr(LAST)}]")


def runs(points: list[int]) -> list[tuple[int, int]]:
    """Ascending code points as ranges, ends inclusive."""
    found: list[tuple[int, int]] = []
    for c in points:
        if found and found[-1][1] == c - 1:
            found[-1] = (found[-1][0], c)
        else:
            found.append((c, c))
    return found


def others(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The code points outside of ranges."""
    edges = [(-1, -1), *ranges, (LAST + 1, LAST + 1)]
    return [(a + 1, b - 1) for (_, a), (b, _) in zip(edges, edges[1:], strict=False) if a + 1 < b]


@cache
def members(name: str) -> tuple[tuple[int, int], ...]:
    """The ranges of a class such as \\p{L}: what the library finds of it in a text of all code points."""
    finder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return tuple(runs(list(map(ord, bytes(finder.encode_ordinary(EVERY)).decode()))))


@cache
def unlike(name: str) -> frozenset[int]:
    """The code points that the regex package counts to a class and the library doesn't, or the other way round."""
    return frozenset({c for a, b in members(name) for c in range(a, b + 1)} ^ set(map(ord, regex.findall(name, EVERY))))


CLASS = re.compile(r"\\(?:(p)\{\^?[A-Za-z_]+\}|(P)\{[A-Za-z_]+\}|([sd])|([SD]))")


def property_of(known: re.Match) -> str:
    """The class that an escape names, or leaves out."""
    return known.group().replace(r"\P", r"\p") if known[1] or known[2] else SHORT[known.group()[1].lower()]


def spelled(ranges, most: int) -> str:
    """Ranges up to a code point, for use in brackets."""
    return "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in ranges if a <= most)


def spelled_out(pattern: str, most: int) -> re.Pattern | None:
    """The pattern for texts without code points beyond `most`, in the standard library's engine; None if it has other escapes or sets of sets."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        if pattern.startswith("[[", i) or inside and pattern[i : i + 2] in ("--", "&&", "||", "~~"):
            return None
        known = CLASS.match(pattern, i)
        if known:
            ranges = members(property_of(known))
            text = spelled(others(list(ranges)) if known[2] or known[4] else ranges, most)
            if not text:
                return None
            out += text if inside else f"[{text}]"
            i = known.end()
            continue
        if pattern[i] == "\\" and pattern[i + 1 : i + 2].isalpha() and pattern[i + 1] not in "nrtfv":
            return None
        step = 2 if pattern[i] == "\\" else 1
        if step == 1 and pattern[i] in "[]":
            inside = pattern[i] == "["
        out += pattern[i : i + step]
        i += step
    try:
        return re.compile(out)
    except re.error:
        return None


class Pieces:
    """The matches of a pattern without groups in a text, as the tokenizer libraries cut them."""

    def __init__(self, pattern: str):
        self.own = regex.compile(pattern)  # faster beyond the first plane, for texts without the code points it takes otherwise
        forms = [spelled_out(pattern, most) for most in (0x7F, PLANE, LAST)]
        self.in_ascii, self.in_plane, self.whole = (self.own if f is None else f for f in forms)
        other = sorted(set().union(*(unlike(property_of(m)) for m in CLASS.finditer(pattern)))) if forms[2] is not None else []
        self.unlike = re.compile(f"[{spelled(runs(other), LAST)}]" if other else "(?!)")

    def form(self, text: str):
        """The compiled pattern for a text."""
        if text.isascii():
            return self.in_ascii
        if BEYOND.search(text):
            return self.whole if self.unlike.search(text) else self.own
        return self.in_plane

    def __call__(self, text: str) -> list[str]:
        return self.form(text).findall(text)
