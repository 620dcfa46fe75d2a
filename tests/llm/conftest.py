import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case: nulls, empty and long texts, repeated rows, columns whose names clash with new ones."""
    long = " ".join(f"wort{k % 977} haus" for k in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "a"), (5, "12 34 !!", "de", "a"),
        (6, long, "de", "b"), (None, "Der Hund und die Katze", "de", "b"), (7, "x", "fr", None), (8, "\U0001f600 éÉİ <|endoftext|>", "fr", "c"),
        (9, "The quick brown fox jumps over the lazy dog and runs away", None, "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    clash = ("score", "n", "f", "band", "lang_pred", "items_held", "u", "part", "bin", "h", "rare")
    return docs.selectExpr("*", "cast(length(text) as bigint) as n_chars", *[f"source as {c}" for c in clash])


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
