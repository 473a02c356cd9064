import pytest


@pytest.fixture(scope="session")
def tidy(spark):
    """Rows with nulls in any column, empty, tiny and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i * 7919 % 104729}" for i in range(60_000))
    base = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa\nSecond line here", "en", "s0", 5),
        (2, None, "en", "s0", None),
        (3, "", None, None, 0),
        (None, "One text without an id", "en", None, 1),
        (4, "x", "", "s1", 1),
        (5, long, "en", "s0", len(long)),
        (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa\nSecond line here", None, "s1", 5),
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa\nSecond line here", "en", "s0", 5),
        (7, " \t\n \n", "en", "s0", 5),
        (8, "naïve café　 日本語 текст İ 😀", "fr", "s2", 9),
        (None, None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = [f"{c} string" for c in ("fp", "id", "k1", "k2", "gone", "found", "c", "c_kept", "n", "low", "root", "lines", "in_0", "n_words", "h", "_l")]
    rows = [(*r, *([str(i)] * len(clash))) for i, r in enumerate(base)]
    return spark.createDataFrame(rows, ", ".join([schema, *clash]))


@pytest.fixture(scope="session")
def nothing(tidy):
    return tidy.limit(0)
