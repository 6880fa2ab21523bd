import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"word{i}." for i in range(20_000))
    same = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen. End here now."
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 2), (2, same, "en", "a", 2), (3, None, "en", None, 3), (4, "", None, "b", 4), (5, " \n\t ", "de", "b", 5),
        (None, "no id but words enough for a shingle or two", "en", "a", 6), (6, "word", "en", "b", 7), (7, long, "fr", "c", 8), (8, "é ü 日本   x", "fr", "c", 9), (9, same + " More.", "en", "a", 10),
    ]
    return spark.createDataFrame([(*r, "u", "v", 0, "t") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, u string, v string, pos int, tail string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
