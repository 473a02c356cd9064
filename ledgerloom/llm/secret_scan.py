"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every historical version of every path is a blob, addressed by the SHA-256 of its content; a rule's version is a hash of what it
looks for. The ledger holds the findings of each (blob, rule version) pair ever scanned. A run hashes all versions, takes the pairs that the ledger lacks, scans one copy of
each such blob under the rules that it lacks, and joins old and new findings back to all paths: a third of all rows may be copies of one text, they cost one
scan, and a rule that is added or changed scans alone.

Spans come from built-in regular-expression functions: a split gives the gaps, an extraction the matches, and
running sums of their lengths the places, in code points, end exclusive. Matches are leftmost and do not overlap
within a kind; those that a rule's least length drops have used up their text.

Defined results: a null text is an empty blob without findings; repeated rows get a row each; an empty table gives an
empty result; pairs of other rules or of other versions of a rule are never read; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, table_path

@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # whose length counts
    least: int
    base: bool = True
    #: Decides cheaply whether a text has a match long enough; only then are its places worked out.
    gate: str | None = None

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]}"


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, gate=r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, gate=r"[0-9a-f]{24}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, base=False),
)
PLACE = "struct<start:int,end:int>"
SPAN = "struct<start:int,kind:int,end:int>"
LEDGER = "blob string, rule_version string, places array<struct<start:int,end:int>>"


def places_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of one rule, in order."""

    def places(m: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.char_length(g))
        kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.char_length(g))
        rows = F.arrays_zip(gaps.alias("gap"), F.transform(m, lambda x: F.char_length(x)).alias("size"), kept.alias("kept"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PLACE}>").alias("out"))

        def step(acc: Column, r: Column) -> Column:
            begin = acc["at"] + r["gap"]
            end = begin + F.coalesce(r["size"], F.lit(0))
            one = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(F.coalesce(r["kept"], F.lit(-1)) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(rows, start, step)["out"]

    found = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), places)
    return F.when(text.rlike(rule.gate or rule.pattern), found).otherwise(F.array().cast(f"array<{PLACE}>"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule_version, places): findings of the pairs that the ledger lacks, pairs without a finding too; append them to it."""
    rows = versions.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_blob", F.sha2("_text", 256))
    unseen = rows.groupBy("_blob").agg(F.min("_id").alias("_low"))
    want = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        unseen = unseen.withColumn("_lacks", want)
    else:
        seen = ledger.where(F.col("rule_version").isin([r.version for r in rules])).groupBy(F.col("blob").alias("_s")).agg(F.collect_set("rule_version").alias("_have"))
        unseen = unseen.join(seen, F.col("_blob") == F.col("_s"), "left")
        unseen = unseen.select("_blob", "_low", F.array_except(want, F.coalesce("_have", F.array().cast("array<string>"))).alias("_lacks")).where(F.size("_lacks") > 0)
    unseen = materialize(unseen.withColumnsRenamed({"_blob": "_u"}), "blobs")
    # one copy of each blob: both columns are keys, so copies of one text don't meet in one task
    one = rows.join(unseen.hint("shuffle_hash"), (rows["_blob"] == unseen["_u"]) & rows["_id"].eqNullSafe(unseen["_low"]))
    scans = [F.when(F.array_contains("_lacks", r.version), F.struct(F.lit(r.version).alias("rule_version"), places_of(F.col("_text"), r).alias("places"))) for r in rules]
    found = one.select(F.col("_blob").alias("blob"), F.filter(F.array(*scans), lambda x: x.isNotNull()).alias("found"))
    found = found.groupBy("blob").agg(F.first("found").alias("found"))
    return found.select("blob", F.explode("found").alias("f")).select("blob", "f.rule_version", "f.places")


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_col, blob, spans): the ledger's findings joined back to every version, one row for each input row; spans of all rules by start, then rule as listed."""
    rows = versions.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob"))
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))])
    own = ledger.where(F.col("rule_version").isin([r.version for r in rules]) & (F.size("places") > 0)).select("blob", number[F.col("rule_version")].alias("kind"), "places")
    spans = F.transform("places", lambda x: F.struct(x["start"].alias("start"), F.col("kind"), x["end"].alias("end")))
    # a blob has one row for each rule
    own = own.select("blob", spans.alias("spans")).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    out = rows.join(own, "blob", "left")
    return out.select(id_col, "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _kind(number: Column, rules: tuple[Rule, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(r.kind) for r in rules]), number + 1)


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s["kind"], rules), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(versions: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date with all versions and join its findings back to them. The ledger is a folder of Parquet files in a shared
    place, made by the first run and kept for the next ones; a run adds files for unseen pairs only."""
    spark = versions.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    read = lambda: spark.read.schema(LEDGER).parquet(ledger_path)
    update_ledger(versions, read() if known else None, id_col, text_col, rules).write.mode("append").option("compression", "zstd").parquet(ledger_path)
    return findings(versions, read(), id_col, text_col, rules)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """(id_col, n_<base kind>..., base_sha256, spans) by the ledger at ``ledger_path``, or by a ledger of this run only."""
    out = scan(docs, ledger_path or table_path(docs.sparkSession, "ledger"), id_col, text_col, rules)
    base = F.filter("spans", lambda s: s["kind"].isin([i for i, r in enumerate(rules) if r.base]))
    n = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return out.select(id_col, *[n(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base], F.sha2(joined(base, rules), 256).alias("base_sha256"), joined(F.col("spans"), rules).alias("spans"))
