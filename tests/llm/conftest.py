import pytest

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def passage(k: int, n: int) -> str:
    """n words that differ between values of k."""
    words = LOREM.split()
    return " ".join(words[(k * 7 + i * (k % 5 + 1)) % len(words)] + str((k * 31 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in each column, empty and blank texts, repeated rows and ids, ties, a long text, and columns with names that operators use."""
    long_text = "\n".join(passage(k, 40) for k in range(400))
    base = passage(3, 80)
    near = base.replace("alpha", "ALPHA") + " tail"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, None, None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \t\n ", "fr", "b"),
        (None, base, "en", "c"),
        (None, None, None, None),
        (7, "one two three", "en", "c"),
        (8, "One  two\tthree", "en", "c"),
        (9, long_text, "de", "c"),
        (9, "another text under a used id, ééé ß 漢字 🙂", "de", "c"),
        (10, "12345 67890 !!!", "en", "d"),
        (11, "<|endoftext|> in a text  with  runs\n\n of space", "en", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    from pyspark.sql import functions as F

    for name in ("k", "rid", "score", "label", "kept", "n_lines", "item_id", "node", "size"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
