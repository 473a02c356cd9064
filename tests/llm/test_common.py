from pyspark.sql import functions as F

from ledgerloom.llm import common


class FakeContext:
    def __init__(self, master):
        self.master, self.applicationId = master, "app-x"


class FakeSession:
    def __init__(self, named, master):
        self.sparkContext = FakeContext(master)
        self.conf = {"spark.checkpoint.dir": named}


def test_shared_folder_comes_from_the_session():
    import pytest

    assert common.shared_dir(FakeSession("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert common.shared_dir(FakeSession(None, "local[4]")) == common.shared_dir(FakeSession(None, "local[4]"))
    with pytest.raises(RuntimeError):
        common.shared_dir(FakeSession(None, "spark://host:7077"))


def test_tables_are_written_and_swept(spark):
    with common.tables_of_run() as made:
        a = common.materialize(spark.range(5), "one")
        with common.tables_of_run() as other:
            inner = common.materialize(spark.range(7), "inner")
        b = common.materialize(a.where("id > 1"), "two")
        assert len(made) == 2 and len(other) == 1
        common.sweep(spark, made, "two")
    assert inner.count() == 7  # another run's table stays
    assert sorted(r["id"] for r in b.collect()) == [2, 3, 4]
    held = []
    c = common.materialize(spark.range(1), "three", held)
    assert c.count() == 1 and len(held) == 1
    common.release(spark, held)
    assert held == []


def test_let_and_shield(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, A_ string")
    inner, at, restore = common.shield(df)
    assert inner.columns == ["in_0", "in_1"] and at("A_") == "in_1" and restore(inner.withColumn("k1", F.lit(1))).columns == df.columns
    assert [r[0] for r in spark.range(3).select(common.let(F.col("id") + 1, lambda x: x * x)).collect()] == [1, 4, 9]


def test_split_by_keys_loses_nothing(spark, monkeypatch):
    """Rows with a key are always in the first part, few others are; a bitmap that is far too small is only slower."""
    rows = spark.range(-3000, 3000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("_p"))
    rows = rows.withColumnRenamed("_p", "p").unionByName(rows.withColumnRenamed("_p", "p").where("id % 7 = 0"))
    keys = spark.range(-3000, 3000, 11).select(F.xxhash64("id").alias("k"))
    ids = set(range(-3000, 3000, 11))
    for bits in (common.FILTER_BITS, 64):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        maybe, none = common.split_by_keys(rows, F.col("h"), keys)
        a, b = [r["id"] for r in maybe.collect()], [r["id"] for r in none.collect()]
        assert sorted(a + b) == sorted(r["id"] for r in rows.collect()) and not ids & set(b) and maybe.columns == rows.columns
        assert bits == 64 or set(a) == ids
    maybe, none = common.split_by_keys(rows, F.col("h"), keys.limit(0))
    assert maybe.count() == 0 and none.count() == rows.count()

