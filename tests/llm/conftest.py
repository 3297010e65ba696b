import pytest

LONG = ("lorem ipsum dolor " * 40_000).strip()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 2
    near = base.replace("sigma", "SIGMA")
    rows = [
        (1, base, "en", "src1", 1, "x"), (2, base, "en", "src1", 1, None), (2, base, "en", "src1", 1, None), (3, near, None, None, None, "y"), (4, None, "en", "src2", 0, "z"),
        (5, "", "fr", "src2", 0, ""), (6, " \n\t ", "fr", "src3", 3, "w"), (7, LONG, "de", "src3", len(LONG), "v"), (8, "one two", "es", "src4", 7, "u"), (9, "One TWO", "es", "src4", 7, "u"),
        (None, base, None, "src5", None, None), (None, None, None, None, None, None), (10, "mail a.b@c.de or 10.0.0.1 token = 'abcdef123456' \U0001F600 cc by 4", "en", "src1", 9, "t"),
        (10, "another text under one id with enough words to be a document of its own", "en", "src1", 9, "t"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
