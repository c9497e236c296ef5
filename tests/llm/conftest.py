import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, id string, fp string, row_hash long, _mix_tokens_mix int, _group_params int"


def prose(seed: int, n: int, words=None) -> str:
    rng = random.Random(seed)
    words = words or [a + b for a in ("ta", "re", "mi", "so", "len", "dor", "ki", "va") for b in ("ne", "lu", "pa", "ri", "st", "om", "", "qui")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and names that the operators use themselves."""
    long = prose(5, 60_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n ", "en", "a"), (None, prose(1, 50), "en", "a"), (4, prose(1, 50), None, "a"), (5, prose(2, 50), "en", None),
        (6, long, "en", "a"), (7, "x" * 300_000, "en", "a"), (8, prose(3, 40), "en", "a"), (8, prose(3, 40), "en", "a"), (9, "!?.", "fr", "b"), (10, "日本語 テキスト 😀 é", "fr", "b"),
        (None, None, None, None), (11, prose(4, 30), "fr", "b"),
    ]
    return spark.createDataFrame([(i, t, x, s, None if t is None else len(t), "g", "i", "f", 1, 2, 3) for i, t, x, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
