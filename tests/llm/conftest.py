"""Helpers for the operators' tests."""

import re

import pytest

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (6, "Übergröße ÀÉ straße — 漢字 🤦‍♂️ \x85 end"),
    (7, "a" * 3000 + " " + "word " * 3000),
    (None, "a row without an id has a text of its own"),
    (8, "token = abcdef123 and AKIA" + "ABCDEFGH01234567" + "\npassword:'xyz' api_key=0123456789abcdef0123456789abcdef"),
]


@pytest.fixture
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use."""
    rows = [(i, t, "x", 1) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def lowered(text):
    return (text or "").translate(UPPER)


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")
