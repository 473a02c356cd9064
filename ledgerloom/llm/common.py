"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rules: U+0020 and U+0009 to U+000D, as a Java/RE2 character class body.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"

_fallback: dict[str, str] = {}
#: Tables written in the current run (``tables_of_run``), if there is one: threads and runs don't see each other's.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process (tests, a laptop) a temporary folder of our own is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _fallback[app], ignore_errors=True)
    return _fallback[app]


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, held: list | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Executors may be lost afterwards without recomputing what stands before. The files go when the
    application ends (``deleteOnExit``) or earlier through ``release``, for which ``held`` gets the path.
    """
    spark = df.sparkSession
    path = table_path(spark, label)
    # zstd streams through small buffers; snappy pages would pile up in direct memory over thousands of short tasks
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    made = _made.get()
    if made is not None:
        made.append(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in held:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()


@contextmanager
def tables_of_run() -> Iterator[list[str]]:
    """Collects the tables that are written inside, for ``sweep``. Other runs in the same process have lists of their own."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def sweep(spark: SparkSession, made: list[str], keep: str) -> None:
    """Delete the tables of a run, but the one under ``keep``: what has been read into it isn't needed any more."""
    gone = [p for p in made if f"/{keep}-" not in p]
    made[:] = [p for p in made if p not in gone]
    release(spark, gone)


def grown(df: DataFrame) -> DataFrame:
    """A join's side that grows with the corpus: sorted and merged at every size, never broadcast, so that small inputs take the plan of large ones."""
    return df.hint("merge")


#: Bits of a key filter: 4 MB in all, whatever the number of keys.
FILTER_BITS = 1 << 25


def split_by_keys(rows: DataFrame, key: Column, keys: DataFrame, held: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that certainly have none). ``keys`` has one long column, ``key`` is the rows' counterpart, both hashed well.
    A bitmap of fixed size is built from the keys and broadcast; only the first part needs a shuffle to meet them. More keys than the bitmap can tell apart make that part
    larger, never wrong. The key must not be null."""
    place = lambda c: F.pmod(c, F.lit(FILTER_BITS).cast("long")) + 1
    bits = keys.select(place(F.col(keys.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_m"))
    bits = materialize(bits, "key-bits", held)  # FILTER_BITS / 32768 rows of 4 kB at most
    at = rows.withColumn("_p", place(key)).join(F.broadcast(bits), F.bitmap_bucket_number("_p") == F.col("_b"), "left")
    bit = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring(F.col("_m"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return at.where(hit).select(*rows.columns), at.where(~hit).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shield(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """Columns by place, so that no name of a caller's column clashes with ours: the renamed table, the new name of
    a column, and what gives the old names back."""
    names = docs.columns
    inner = docs.toDF(*[f"in_{i}" for i in range(len(names))])
    return inner, lambda name: f"in_{names.index(name)}", lambda out: out.select(*[F.col(f"in_{i}").alias(n) for i, n in enumerate(names)])


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often the body names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_array(text: Column) -> Column:
    """Words of the white-space rule, as an array."""
    return F.filter(F.split(text, rf"[{WS}]+"), lambda w: F.length(w) > 0)
