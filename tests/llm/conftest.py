import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, verdict string, payload string, tokens string"


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    long = " ".join(f"word{i % 977} other{i}" for i in range(20_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 7),
        (2, "one two  three\tfour five six seven", "en", "a", 7),
        (3, None, "en", "a", 0),
        (4, "", None, None, None),
        (5, " \t\n", "de", "b", 3),
        (6, long, "en", "b", len(long)),
        (7, "ç'est déjà l'été ; it's 12,5 % — don't! 中文", None, "c", 9),
        (8, "same row", "en", "c", 8),
        (8, "same row", "en", "c", 8),
        (None, "no key", "en", "d", 6),
        (None, None, None, None, None),
        (9, "x" * 5000, "fr", "d", 5000),
        (10, "12 34 !!", "es", "d", 8),
    ]
    return spark.createDataFrame([(*r, *("old",) * 6) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
