import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, slot long, digest string, name string, size int, bucket int, kept boolean"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = ["th", "er", "an", "on", "in", "re", "es", "at", "ing", "ble"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","]) for _ in range(words))


def corpus() -> list[tuple]:
    """Small hostile corpus: copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows."""
    base, shared = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), base.upper(), None, "", "  \n\t ", "one", "one two", "one two three", "One TWO three", shared + "\n" + prose(3, 80),
             prose(4, 70) + "\n" + shared, "x" * 30000, prose(5, 9000), "line\nline\nline other\n\nline", "é ñ 日本語 😀 " * 30, base + " tail", None, ""]
    texts += [prose(100 + i, 60 + 5 * i) for i in range(40)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], 0, 7, 7, "x", "y", 1, 1, True) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[12], (None, base, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def hostile(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
