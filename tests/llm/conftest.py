import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, h long, digest string, bucket int, label string, kept boolean"


def words(seed, n, size=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def rows():
    """Nulls in any column, empty and blank texts, copies, ties, a very long text, near copies."""
    base = words(1, 300)
    near = list(base)
    for i in (50, 150):
        near[i] = "changed"
    far = list(base)
    for i in range(0, 300, 12):
        far[i] = "far"
    texts = [
        None, "", " \t\n ", "one two", "one two", " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far), "# % $ " * 60, "same words here " * 80, "A line of some length\nshort\n\nA line of some length \nA LINE OF SOME LENGTH",
        "a line of some length\nanother line that stays\nwith é and ß and 日本語 text", " ".join(words(2, 60_000, 50_000)), "\n".join(f"line number {i % 7} repeated" for i in range(40)), " ".join(words(3, 80)), "1234 5678 !!! ???", "日本語",
    ]
    out = [(i, t, None if i % 5 == 0 else "en", "src0", len(t) if t else None, "x", i, None, 1, "l", True) for i, t in enumerate(texts)]
    return [*out, (None, "null id with some words in the line", "en", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain():
    return [(r[0], r[1]) for r in rows()]
