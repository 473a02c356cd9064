import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", 0), ("  ", 0), ("1e6", 1_000_000), ("1.0", 1), ("0x10", 16), ("0b101", 5), ("0o17", 15), ("1,000", None), ("1.5", None), ("-1", None), ("abc", None), ("9007199254740991", 9007199254740991), ("9007199254740992", None), (" 7 ", 7), ("+7", 7), ("1e400", None)],
)
def test_integers(spark, raw, want):
    assert one(spark, raw, X.parse_integer) == want


def test_amount(spark):
    assert one(spark, "12,34,567", X.amount) == 1234567


def test_clean(spark):
    assert one(spark, "  a\x00b\x7f c　", X.clean_text) == "ab c"
    assert one(spark, None, X.clean_text) == ""
    assert one(spark, "a😀", X.utf16_length) == 3


@pytest.mark.parametrize(("raw", "want"), [("", True), ("Yes", True), (" 1 ", True), ("FALSE", False), ("no", False), ("0", False), ("maybe", None)])
def test_booleans(spark, raw, want):
    assert one(spark, raw, X.parse_boolean) is want


@pytest.mark.parametrize(("n", "want"), [(None, "—"), (0, "0"), (999, "999"), (1000, "1,000"), (99999, "99,999"), (1234567, "12,34,567"), (-123456789, "-12,34,56,789")])
def test_money(spark, n, want):
    assert spark.createDataFrame([(n,)], "v long").select(X.indian_grouping(F.col("v")).alias("x")).first()["x"] == want


def test_small_ones(spark):
    assert one(spark, "Ann van Lee", X.initials) == "AL" and one(spark, "bolt", X.initials) == "BOL" and one(spark, "", X.initials) == ""
    assert one(spark, "1234", lambda c: X.pad(c, 3)) == "1234" and one(spark, "7", lambda c: X.pad(c, 3)) == "007"
    assert one(spark, "a.b_c", X.action_text) == "a b c"
    assert one(spark, "Batsman", X.normal_role) == "Batter" and one(spark, "umpire", X.normal_role) is None
    assert one(spark, "a=1; b=%20x; a=2; bad=%ZZ; noeq", X.cookies) == {"a": "2", "b": " x", "bad": ""}
    tiers = one(spark, "1,000: 50\n\n*: 100", X.parse_tiers)
    assert [tuple(t) for t in tiers] == [(1000, 50), (None, 100)]
    assert spark.range(1).select(X.tier_text(F.lit(None).cast("long"), F.lit(5)).alias("x")).first()["x"] == "*: 5"
    assert spark.range(1).select(X.size_kb(F.lit(1536)).alias("x")).first()["x"] == "1.5 KB"
