import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and extra columns with awkward names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace("a", "b", 1), "en", None, 5) for i, t in enumerate(base[:6])]  # near copies
    rows += [(200 + i, base[0], None, "s0", 1) for i in range(5)]  # copies
    rows += [(3, base[3], "en", "s0", 1), (3, base[3], "en", "s0", 1)]  # repeated rows
    rows += [(None, base[4], "en", "s1", 1), (None, None, None, None, None), (300, None, "en", "s1", 0), (301, "", "de", "s2", 0), (302, " \t\n ", "de", "s2", 3)]
    rows += [(400, "word " * 30_000, "en", "s1", 1), (401, "x" * 100_000, "en", "s1", 1), (402, "ünï çødé 漢字 😀 ok " * 20, "fr", "s2", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("block", "src", "_row", "fp", "row", "_id", "size", "component_id", "keep", "words", "rank"):
        df = df.selectExpr("*", f"'extra' AS `{c}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
