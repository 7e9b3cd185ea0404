import random

import pytest

WORDS = "the of and tion ing river stone light paper cloud winter garden music bridge ocean silver".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ly", "er", "s"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank, tiny, very long and repeated texts, near copies and shared passages: (doc_id, text, lang, source, n_chars)."""
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", None, 4), (3, "one", "en", "b", 3), (4, base, "en", "a", None), (5, base, None, "c", 1), (6, near, "en", "a", 1),
        (7, prose(3, 30) + " " + passage + " " + prose(4, 30), "en", "b", 1), (8, prose(5, 25) + "\n" + passage + "\n" + prose(6, 40), "en", "c", 1), (9, "same same " * 60, "en", "a", 1),
        (10, "same same " * 40, "en", "b", 1), (11, prose(7, 6000), "en", "c", 1), (12, "été déjà 日本 " * 15, "fr", "d", 1), (13, base.upper(), "en", "a", 1), (14, base, "en", "a", 1), (14, base, "en", "a", 1),
        (15, "x" * 50000, "en", "b", 1), (-3, "a b c", "en", "a", 1), (16, "one", "en", "b", 3), (17, "a\x0bb\x0cc d e", "en", "a", 1),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names clash with what the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(("size", "doc", "pair", "row", "rank", "name", "marks", "turn", "shard", "kept", "score", "component_id", "held_out", "g", "ids"))))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
