"""Small tables with every awkward case, and helpers to compare with brute force."""

import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is it lowly river stone green seven winter market paper window garden letter silver morning".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(rng):
    """Rows with nulls in every column, empty, blank and long texts, ties and repeated rows."""
    base = prose(rng, 60)
    texts = [None, "", " ", "\n\t ", "one", "Two words", "three Short words", base, base, base + " end", base.upper(), prose(rng, 4000), "É à ü 日本 😀", "a\x00b \x85 c d", "x" * 5000, "MIT License.", "line\nline\nother\nline"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s1", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, "en", "s1", 1), (None, None, None, None, None), (None, "", "en", "s2", 0)]
    return rows


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows with extra columns whose names clash with those of the operators."""
    rows = [(*r, "extra", 1, "x") for r in awkward(random.Random(5))]
    return spark.createDataFrame(rows, f"{KINDS}, row string, size int, `fp` string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
