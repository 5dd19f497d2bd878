import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Names that operators use inside, as columns of the input.
CLASHING = ("size", "key", "mix", "toxicity", "set", "path", "root", "shard", "kind", "digest", "matches", "first", "n", "term", "idx", "spans")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def messy_rows() -> list[tuple]:
    shared = prose(99, 60)
    rows = [
        (1, prose(1, 80), "en", "b", 1),
        (2, prose(1, 80), "en", "b", 1),  # a copy
        (3, prose(1, 80) + " extra", "en", None, 1),  # a near copy
        (4, None, None, "a", None),
        (5, "", "en", "a", 0),
        (6, "   \n\t ", "en", "a", 5),
        (7, "one", "en", None, 3),
        (8, prose(8, 40) + "\n" + shared + "\n" + prose(9, 40), "en", "c", 1),
        (9, shared + " " + prose(10, 30), "en", "c", 1),
        (10, prose(11, 20_000), "en", "b", 1),  # very long
        (10, prose(11, 20_000), "en", "b", 1),  # a repeated row
        (11, "é" * 150 + " " + "日本 " * 120 + shared, "fr", "Z", 1),
        (None, prose(12, 70), "en", "b", 1),
        (None, prose(13, 70), "en", "b", 1),
        (12, "x" * 5000, "en", "b", 1),
        (13, "spam " * 400, "en", "b", 1),
        (9_000_000_000_000, prose(14, 70), "en", "a", 1),
        (-5, prose(15, 70) + "  two  spaces\n\nand lines\t", "en", "a", 1),
    ]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType())])


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, copies, repeated rows, odd ids, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(), SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")
