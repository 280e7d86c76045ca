import random

import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, doc string, rank int"


def odd_rows():
    """Nulls, empty, blank and very long texts, ties, copies, repeated rows; column names that operators use inside."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.split()
    near[60] = "other"
    page = "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(12))
    long = " ".join(rng.choice(words) for _ in range(60_000))
    texts = [
        base, " ".join(near), base, None, "", " \n\t ", page, "intro line\n" + page + "\nlast line", page, long,
        "x " * 300, "one", "one two three", "### $$$ | <b>", "é ü 日本     end", base + "\n" + page,
        "same\nsame\nsame\nsame", "A\x0bB\x0cC\rD",
    ]
    rows = [
        (i, t, [None, "en", "de"][i % 3], [None, "a", "b", "b"][i % 4], len(t or ""), "s", "d", i)
        for i, t in enumerate(texts)
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def repeated(spark):
    """Every row twice, and a row without an id."""
    rows = odd_rows()
    return spark.createDataFrame(rows + rows + [(None, rows[0][1], "en", "a", 3, "s", "d", 1)], SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
