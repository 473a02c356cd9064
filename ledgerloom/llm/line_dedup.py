"""Line dedup by winnowing over line hashes (DataFrame functions only).

Lines with a word are hashed (outer white space apart). From each line the shortest span of lines with ``SPAN_WORDS`` words gives a span
hash; of the span hashes that start within ``REACH_WORDS`` words the smallest is selected. So two texts that share a
line-aligned run of SPAN_WORDS + REACH_WORDS words (50) select at least one span in common: the fingerprints are guaranteed.

Round each fingerprint that stands at two places, the shortest runs of lines with ``MIN_RUN_WORDS`` words, at every alignment, are hashed too. An
aggregate gives the earliest place of each such run, in the order of (doc_id, text hash, line); at every later place its lines go. So each run has an
earliest place of its own, whichever texts hold parts of it, and longer runs are unions of such runs. No pairs among places are made: a passage in a
third of all documents costs a few rows for each of them. What is deleted stands earlier in the same order, so the first copy of every line stays.

Defined results: null, empty and wordless texts stay as they are; lines without a word between deleted lines stay; rows that repeat
both id and text count as one place and lose the same lines; ids that aren't whole numbers are ordered as strings, null ids come last; a text may lose all its lines and is then empty; an empty table gives an
empty result; all columns of the input come back, clashing names too, and every row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS, grown, let, materialize, release, shield, split_by_keys

SPAN_WORDS, REACH_WORDS, MIN_RUN_WORDS = 20, 30, 50


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, lines): key of the text and its lines with a word: original number, hash, words."""
    text = F.col(text_col).cast("string")
    bare = lambda x: F.regexp_replace(x, rf"^[{WS}]+|[{WS}]+$", "")
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.xxhash64(bare(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    lines = F.filter(lines, lambda x: x["w"] > 0)
    return docs.where(text.isNotNull()).select(*keys_of(docs, id_col, text_col), lines.alias("lines")).where(F.size("lines") > 0)


def keys_of(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Id and hash of the text, in an order in which null ids come last."""
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        key = F.coalesce(F.col(id_col).cast("long"), F.expr("9223372036854775807L"))
    else:
        key = F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1"))
    return [key.alias("k1"), F.xxhash64(F.col(text_col).cast("string")).alias("k2")]


def ahead(ls: Column, i: Column, most: int, body) -> Column:
    """``body`` over line i and the next ones, ``most`` lines in all at most, by place: no part of the array is copied."""
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.size(ls) - i) - 1), lambda k: body(F.get(ls, i + k)))


def shortest(words: Column, least: int) -> Column:
    """Number of leading entries whose words reach ``least``, null if all together don't."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    got = F.aggregate(words, start, lambda a, w: F.when(a["w"] >= least, a).otherwise(F.struct((a["w"] + w).alias("w"), (a["n"] + 1).alias("n"))))
    return let(got, lambda g: F.when(g["w"] >= least, g["n"]))


def hash_of(ls: Column, i: Column, n: Column) -> Column:
    return F.xxhash64(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(ls, i + k)["h"]))


def span_hashes(lines: Column) -> Column:
    """For each line the hash of the shortest span with SPAN_WORDS words, null if the text ends before."""

    def one(ls: Column, i: Column) -> Column:
        n = shortest(ahead(ls, i, SPAN_WORDS, lambda x: x["w"]), SPAN_WORDS)  # every line has a word
        return let(n, lambda n: F.when(n.isNotNull(), hash_of(ls, i, n)))

    return let(lines, lambda ls: F.transform(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: one(ls, i)))


def selected(lines: Column, spans: Column) -> Column:
    """Distinct (position, span hash) of the minima of all windows, ties to the right."""

    def minimum(rows: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("before"), F.lit(None).cast("long").alias("h"), F.lit(-1).alias("p"), i.alias("at"))

        def step(a: Column, x: Column) -> Column:
            better = (a["before"] <= REACH_WORDS) & x["g"].isNotNull() & (a["h"].isNull() | (x["g"] <= a["h"]))
            return F.struct((a["before"] + x["w"]).alias("before"), F.when(better, x["g"]).otherwise(a["h"]).alias("h"), F.when(better, a["at"]).otherwise(a["p"]).alias("p"), (a["at"] + 1).alias("at"))

        return let(F.aggregate(ahead(rows, i, REACH_WORDS + 1, lambda x: x), start, step), lambda a: F.struct(a["p"].alias("p"), a["h"].alias("h")))

    rows = F.zip_with(lines, spans, lambda x, g: F.struct(x["w"].alias("w"), g.alias("g")))
    minima = let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: minimum(r, i)))
    # both ends of the windows only move on, and so do their minima: equal ones are neighbours
    return let(minima, lambda m: F.filter(m, lambda x, i: (x["p"] >= 0) & ((i == 0) | (x["p"] != F.get(m, i - 1)["p"]))))


_FIELD = 1 << 31


def windows(lines: Column, words: int) -> Column:
    """Distinct position * 2^31 + lines of the shortest runs of lines with ``words`` words that start or end at each line. A longer run is the union of
    those inside it: a line that the run's first window leaves out has ``words`` words of the run before it."""

    def both(ls: Column, i: Column) -> Column:
        on = shortest(ahead(ls, i, words, lambda x: x["w"]), words)  # every line has a word
        back = shortest(F.transform(F.sequence(F.lit(0), F.least(F.lit(words), i + 1) - 1), lambda k: F.get(ls, i - k)["w"]), words)
        return F.array(i.cast("long") * _FIELD + on, let(back, lambda n: (i - n + 1).cast("long") * _FIELD + n))

    found = let(lines, lambda ls: F.flatten(F.transform(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: both(ls, i))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def counts_before(places: Column, n: Column) -> Column:
    """For each of the places 0 to n, how many of the sorted distinct ``places`` are smaller."""
    steps = lambda p: F.transform(p, lambda q, i: F.array_repeat(i, q - F.coalesce(F.get(p, i - 1), F.lit(-1))))
    return let(places, lambda p: F.concat(F.flatten(steps(p)), F.array_repeat(F.size(p), n - F.coalesce(F.get(p, F.size(p) - 1), F.lit(-1)))))


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS, held: list | None = None) -> DataFrame:
    """(k1, k2, gone): numbers of the lines that go, for texts that lose any."""
    held = [] if held is None else held
    lines = materialize(line_table(docs, id_col, text_col), "lines", held)
    marked = lines.withColumn("spans", span_hashes(F.col("lines")))
    prints = marked.select("k1", "k2", F.explode(selected(F.col("lines"), F.col("spans"))).alias("s")).select("k1", "k2", F.col("s.p").alias("p"), F.col("s.h").alias("h"))
    prints = materialize(prints, "fingerprints", held)
    place = F.struct("k1", "k2", "p")
    twice = materialize(prints.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h"), "repeated-fingerprints", held)
    hit = materialize(prints.join(grown(twice), "h").groupBy("k1", "k2").agg(F.collect_set("p").alias("places")), "matches", held)
    # one row for each text: repeated rows share a key
    need = lines.join(grown(hit), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    # windows that hold a place: counts of places before both ends differ
    at = lambda x: F.floor(x / _FIELD).cast("int")
    size = lambda x: (x % _FIELD).cast("int")
    runs = let(
        F.struct("lines", counts_before(F.sort_array("places"), F.size("lines")).alias("upto")),
        lambda z: F.transform(
            F.filter(windows(z["lines"], min_run_words), lambda x: F.get(z["upto"], at(x) + size(x)) > F.get(z["upto"], at(x))),
            lambda x: F.struct(
                at(x).alias("p"), hash_of(z["lines"], at(x), size(x)).alias("h"), F.transform(F.sequence(F.lit(0), size(x) - 1), lambda k: F.get(z["lines"], at(x) + k)["i"]).alias("own")
            ),
        ),
    )
    runs = need.select("k1", "k2", F.explode(runs).alias("x")).select("k1", "k2", "x.p", "x.h", "x.own")
    runs = materialize(runs, "runs", held)
    first = runs.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    first = materialize(first.select("h", "first"), "first-places", held)
    later = runs.join(grown(first), "h").where(place != F.col("first"))
    return later.groupBy("k1", "k2").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` without later repeated runs of lines: every row stays. ``removed`` names an extra column for the number of deleted
    lines."""
    inner, at, restore = shield(docs)
    i, t = at(id_col), at(text_col)
    held: list[str] = []
    gone = materialize(deletions(inner, i, t, min_run_words, held), "deletions")
    release(docs.sparkSession, held)
    hit = gone.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "gone")
    k1, k2 = keys_of(inner, i, t)
    rows = inner.withColumns({"k1": k1, "k2": k2})
    # most texts lose nothing and stay where they are; the others meet the deletions in a hashed join, whatever the size
    maybe, same = split_by_keys(rows, F.xxhash64("k1", "k2"), gone.select(F.xxhash64("k1", "k2")))
    out = maybe.join(hit.hint("shuffle_hash"), (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
    # lines whose number isn't deleted: the counts of deletions before both their ends are equal
    left = let(
        F.split(F.col(t).cast("string"), "\n"),
        lambda ls: let(counts_before(F.col("gone"), F.size(ls)), lambda c: F.array_join(F.filter(ls, lambda x, i: F.get(c, i) == F.get(c, i + 1)), "\n")),
    )
    out = out.withColumn(t, F.when(F.col("gone").isNull(), F.col(t)).otherwise(left.cast(inner.schema[t].dataType)))
    out = out.unionByName(same.withColumns({"gone": F.lit(None).cast("array<int>"), "g1": F.lit(None).cast(out.schema["g1"].dataType), "g2": F.lit(None).cast("long")}))
    if not removed:
        return restore(out)
    n = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)], n.alias(removed))
