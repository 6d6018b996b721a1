import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, score double"


def prose(rng, words, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ".", ","])
                    for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and long texts, repeats, other scripts; the last columns clash with results."""
    rng = random.Random(5)
    long = prose(rng, 12_000)
    texts = [None, "", " \n\t ", "one", "one two", "a b c", long, long, prose(rng, 80), "x" * 5000,
             "Über Straße ΣΑΣ — “quoted” 漢字 한국어 🙂🙂 é İ", "word " * 300, "<|endoftext|> it's <|startoftext|>",
             "!!! *** $$$ %%%", "a\x1cb\x85c d\xa0e", "line\nline\n\nline\n line"]
    rows = [(n, t, ("en", "de", None)[n % 3], None, None if t is None else len(t), "no", 7, -1.0)
            for n, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, prose(rng, 60), None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
