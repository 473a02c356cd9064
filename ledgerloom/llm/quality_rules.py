"""Quality rules with thresholds that adapt to language and source (DataFrame functions only).

Every text gets exact counts by array functions in its own row: no shuffle, no exploded words. Four ratios of these counts go
into quantile sketches: a sketch is the histogram of a ratio in steps of one thousandth up to ``BINS`` and of less than two per cent above, so it is
exact to a step, of bounded size and merged by adding counts. The ratio itself is held against the fence. Sketches are kept for (lang, source), merged to
lang and to the whole table. The quartiles of a group are averaged with those of the level above, which counts as ``prior`` documents: a group of a few
documents takes nearly its language's quartiles, a large one its own, and none changes its fence at a certain size. The upper fence of a ratio is
q3 + ``fences`` * max(q3 - q1, least spread); documents above a fence go, whatever their language or source normally looks like.

Defined results: a null text has no words; null languages and sources are groups of their own; equal ratios share a bin and a verdict; repeated rows get a row each; an empty table gives an empty result; ``keep`` returns
all columns of its input, clashing names too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, materialize, shield, words_array

MIN_WORDS = 50
#: ratio -> (numerator, denominator, least spread in thousandths)
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 20),
    "dup_lines": ("n_dup_lines", "n_lines", 170),
    "repeats": ("n_repeat_words", "n_words", 100),
    "word_length": ("word_chars", "n_words", 1500),
}
FENCES, PRIOR, BINS = 3, 20, 20_000


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.transform(F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))), lambda x: x["i"]))
        at = let(F.sort_array(twice), lambda s: F.transform(s, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(s, i - 1)))))
        return F.aggregate(at, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        # most texts repeat no window: a set of longs tells that without a sort
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, count))


def counts(text: Column) -> Column:
    """Struct of the base counts of one whole text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{WS}]"))
    per_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    bare = F.regexp_replace(text, rf"[{WS}]+", "")
    return let(
        words_array(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(bare).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            per_line["n_lines"].alias("n_lines"),
            per_line["n_dup_lines"].alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def ratio(c: Column, name: str) -> Column:
    top, bottom, _ = RATIOS[name]
    return F.least(F.expr("1000L") * c[top] - F.pmod(F.expr("1000L") * c[top], F.greatest(c[bottom], F.lit(1))), F.lit(1 << 50)) / F.greatest(c[bottom], F.lit(1))


def with_ratios(df: DataFrame, c: str) -> DataFrame:
    """Whole thousandths."""
    col = F.col(c)
    return df.withColumns({f"{c}_{r}": F.floor(ratio(col, r)).cast("long") for r in RATIOS})


def bin_of(thousandths: Column) -> Column:
    """The bin of a sketch: thousandths up to BINS, above them the number with all but its leading seven bits cleared."""
    step = F.pow(F.lit(2), F.length(F.bin(thousandths)) - 7).cast("long")
    return F.when(thousandths <= BINS, thousandths).otherwise(thousandths - F.pmod(thousandths, step))


def sketches(rows: DataFrame, c: str, lang: str, source: str) -> DataFrame:
    """(lang, source, ratio, bin, n): one histogram for each ratio and group."""
    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bin_of(F.col(f"{c}_{r}")).alias("bin")) for r in RATIOS]))
    return rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), bins.alias("s")).groupBy("lang", "source", F.col("s.ratio").alias("ratio"), F.col("s.bin").alias("bin")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str], p: str) -> DataFrame:
    """(keys, ratio, {p}_n, {p}_1, {p}_3): documents and quartiles of each merged sketch, whose bins are one bounded array."""
    listed = sketch.groupBy(*keys, "ratio").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias(f"{p}_n"))

    def quartile(k: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("q"))
        reach = lambda a, x: F.when(a["q"].isNull() & (4 * (a["upto"] + x["n"]) >= k * F.col(f"{p}_n")), x["bin"]).otherwise(a["q"])
        return F.aggregate("bins", start, lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), reach(a, x).alias("q")))["q"]

    return listed.select(*keys, "ratio", f"{p}_n", quartile(1).alias(f"{p}_1"), quartile(3).alias(f"{p}_3"))


def limits(fine: DataFrame, prior: int = PRIOR, fence: int = FENCES) -> DataFrame:
    """(lang, source, up_<ratio>): the upper fences of every group."""
    by_lang = merge(fine, ["lang"])
    a, b, z = quartiles(fine, ["lang", "source"], "a"), quartiles(by_lang, ["lang"], "b"), quartiles(merge(by_lang, []), [], "z")
    b = b.select(F.col("lang").alias("_l"), F.col("ratio").alias("_r"), "b_n", "b_1", "b_3")
    z = z.select(F.col("ratio").alias("_z"), "z_1", "z_3")  # a row for each of the four ratios
    rows = a.join(b, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ratio") == F.col("_r"))).join(F.broadcast(z), F.col("ratio") == F.col("_z"))

    def mixed(q: str) -> Column:
        above = F.floor((F.col("b_n") * F.col(f"b_{q}") + prior * F.col(f"z_{q}")) / (F.col("b_n") + prior))
        return F.floor((F.col("a_n") * F.col(f"a_{q}") + prior * above) / (F.col("a_n") + prior))

    rows = rows.select("lang", "source", "ratio", mixed("1").alias("q1"), mixed("3").alias("q3"))
    spread = F.create_map(*[x for r, (_, _, s) in RATIOS.items() for x in (F.lit(r), F.lit(s))])
    up = F.col("q3") + fence * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("ratio")])
    return rows.withColumn("up", up).groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == r, F.col("up"))).alias(f"up_{r}") for r in RATIOS])


def judge(rows: DataFrame, c: str, lang: str, source: str, prior: int = PRIOR, fence: int = FENCES) -> DataFrame:
    """``rows`` with a boolean ``{c}_kept``: joined with the fences of their group."""
    fine = materialize(sketches(rows, c, lang, source), "quality-sketches")
    up = limits(fine, prior, fence)
    up = materialize(up.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[F.col(f"up_{r}").alias(f"_up_{r}") for r in RATIOS]), "quality-limits")
    held = rows.join(up, rows[lang].eqNullSafe(up["_l"]) & rows[source].eqNullSafe(up["_s"]), "left")
    within = ~base_failed(F.col(c))
    for r in RATIOS:
        within &= F.col(f"{c}_{r}") <= F.col(f"_up_{r}")
    return held.select(*[rows[x] for x in rows.columns], within.alias(f"{c}_kept"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): one row for each input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), counts(text).alias("c"))
    rows = materialize(with_ratios(rows, "c"), "quality-counts")
    return judge(rows, "c", "_lang", "_source").select(
        F.col("_id").alias(id_col),
        *[F.col(f"c.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(F.col("c")).alias("base_failed"),
        F.col("c_kept").alias("kept"),
    )


def keep(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    inner, at, restore = shield(docs)
    text = F.coalesce(F.col(at(text_col)).cast("string"), F.lit(""))
    rows = materialize(with_ratios(inner.withColumn("c", counts(text)), "c"), "quality-counted")
    return restore(judge(rows, "c", at(lang), at(source)).where("c_kept"))
