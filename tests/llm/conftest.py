import random

import pytest

#: Names that operators use inside, as columns of the input.
CLASHING = ("size", "fp", "key", "k", "score", "shard", "label", "first", "last", "block", "_w", "_b", "_id", "_nth", "_spans", "tile", "bucket", "side", "g", "held_out", "kept")


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and unusual white space."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    long = " ".join(word() for _ in range(30_000))
    line = " ".join(word() for _ in range(80))
    texts = [None, "", "   \n\t", "a", "a b", "A\x0bb\x85c\xa0d", line, line, line.encode().upper().decode(), f"{line}\n{line}", long, long[5:], "x " * 500, "12 34 !!", "日本語 テキスト ABC", "<|endoftext|> it's é", "<|ENDOFTEXT|> a<|endoftext|>b"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    passage = " ".join(word() for _ in range(60))
    more = [(7, f"{word()} {passage}", "fr", "s2", 9), ((1 << 53) + 1, passage, "en", None, None), (None, f"{passage} {word()} {word()}", None, "s2", 4), (None, None, None, None, None)]
    return rows + [rows[6], rows[3], (3, "other text for a known id", "en", "s1", 5), *more]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
