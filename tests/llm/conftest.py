"""Documents with the awkward cases: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["th", "and", "stone", "river", "light", "cloud", "quiet", "house", "green", "under", "walk", "seven", "paper", "glass", "north", "table"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list:
    base = [prose(k, 40 + k) for k in range(12)]
    near = base[0].split()
    near[20] = "changed"
    chain = [" ".join(["w%d" % (k // 9)] + base[1].split()[1:]) for k in range(3)]
    return [*base, base[0], base[0], " ".join(near), *chain, None, "", "", " ", "one two", "one two", "  double  spaces \n\n and\ttabs ", "x" * 3000, "don't 12 漢字 é ü " * 50, prose(99, 5000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 0), (None, texts[4], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
