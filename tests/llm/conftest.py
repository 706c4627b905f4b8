"""Rows that every corpus operator must take: nulls, empty and long texts, repeats, clashing columns, no rows."""

import random

import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, ids string, start int, length int, n int, label int, secret_spans string, salt int, component_id long"


def prose(n, seed, words=("the", "of", "thon", "erst", "hand", "tion", "wher", "and", "blest", "oran", "itin", "edsh")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    rows = [(1, None), (2, ""), (3, prose(60, 3)), (3, prose(60, 3)), (None, prose(40, 5)), (None, None), (7, "a"), (8, prose(30_000, 8)), (9, " \t\n "), (10, prose(60, 3)), (11, "é \u00a0 ñ\x1cb 中文\u2003x <|endoftext|> it's\n\nB"), (12, "x" * 50_000)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    rows = [(d, t, None, "s", 5, 1, True, "i", 0, 0, 0, 0, "z", 1, 4) for d, t in messy_rows]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EXTRA)
