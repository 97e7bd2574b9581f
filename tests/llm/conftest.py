import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, id string, row string, h long"


def spell(number: int) -> str:
    """A word for a number."""
    out = "w"
    while number:
        number, digit = divmod(number, 20)
        out += "bcdfghjklmnpqrstvwxz"[digit] + "aeiou"[digit % 5]
    return out


def words(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(spell(rng.randrange(vocabulary)) + ("." if i % 9 == 8 else "") for i in range(n))


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows; columns whose names the operators use inside."""
    extra = ("x", "y", "z", 7)
    rows = [(i, words(i, 120 + i), "en", f"src{i % 5}", 0, *extra) for i in range(20)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(100, rows[4][1], "de", "src1", 0, *extra), (101, rows[4][1] + " tail", "fr", "src2", 0, *extra)]  # copies
    rows += [(102, "", "en", "src0", 0, *extra), (103, "   \n\t ", "en", "src0", 3, *extra), (104, None, None, None, None, None, None, None, None), (None, words(9, 90), None, "src0", 5, *extra), (105, "one", None, None, 3, *extra)]
    rows += [(106, words(77, 30_000), "es", "src3", 1, *extra), (107, "same " * 5000, "es", "src3", 1, *extra), (5, words(500, 80), "en", "src0", 1, *extra)]  # an id twice, with two texts
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
