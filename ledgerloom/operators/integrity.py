"""Integrity constraints as one violations relation: (check_id, entity, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violation(df: DataFrame, check: str, entity: str, key: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def orphans(facts: DataFrame, fk: str, dim: DataFrame, pk: str, key: str, entity: str) -> DataFrame:
    """Facts whose non-null reference is missing in the dimension."""
    known = dim.select(F.col(pk).alias("_pk"))
    bad = facts.where(F.col(fk).isNotNull()).join(known, F.col(fk) == F.col("_pk"), "left_anti")
    return violation(bad, "fk", entity, key, F.col(fk))


def duplicates(df: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Groups of a key with two rows or more."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit("duplicate").alias("check_id"), F.lit(entity).alias("entity"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), F.col("n").cast("string").alias("detail"))


def overspent(finance: DataFrame) -> DataFrame:
    return violation(finance.where("remaining < 0"), "overspent", "team", "team_id", F.col("remaining"))


def tier_order(tiers: DataFrame, entered: bool = False) -> DataFrame:
    """Ceilings must be above all ceilings before them and increments positive; open tiers may stand anywhere. ``entered``: the stricter rule for new
    settings, by which only the last tier may be open. Tiers are a short settings list."""
    by = Window.partitionBy("set_id").orderBy("tier_no")
    highest = F.greatest(F.max("up_to").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    rows = tiers.withColumns({"_before": highest, "_last": F.lead("tier_no").over(by).isNull()})
    wrong = (F.col("up_to") <= F.col("_before")) | (F.col("increment") < 1)
    if entered:
        wrong |= F.col("up_to").isNull() & ~F.col("_last")
    bad = rows.where(F.coalesce(wrong, F.lit(False)))
    return bad.select(F.lit("entered tiers" if entered else "tiers").alias("check_id"), F.lit("settings").alias("entity"), F.concat_ws("/", "set_id", "tier_no").alias("key"), F.coalesce(F.col("up_to").cast("string"), F.lit("open")).alias("detail"))


def transaction_fields(tx: DataFrame) -> DataFrame:
    """A known type, a positive sequence, and the fields that each type needs: a sale has a team, a positive price and a reversal flag, an unsold lot has no team, an undo has a
    reference."""
    none = lambda c: F.coalesce(c, F.lit(False))
    sale = F.col("team_id").isNotNull() & none(F.col("price") > 0) & F.col("reversed").isNotNull()
    wrong = (
        F.when(~none(F.col("type").isin("sale", "unsold", "undo")), "type")
        .when(~none(F.col("sequence") > 0), "sequence")
        .when((F.col("type") == "sale") & ~sale, "sale")
        .when((F.col("type") == "unsold") & F.col("team_id").isNotNull(), "unsold")
        .when((F.col("type") == "undo") & F.col("reference_id").isNull(), "undo")
    )
    return violation(tx.withColumn("_wrong", wrong).where(F.col("_wrong").isNotNull()), "transaction_fields", "transaction", "tx_id", F.col("_wrong"))


def undo_references(ledger: DataFrame) -> DataFrame:
    """An undo must refer to a transaction with a lower position."""
    target = ledger.select(F.col("tx_id").alias("_id"), F.col("pos").alias("_pos"))
    undo = ledger.where("type = 'undo'").join(target, F.col("reference_id") == F.col("_id"), "left")
    bad = undo.where(F.col("_pos").isNull() | (F.col("_pos") >= F.col("pos")))
    return violation(bad, "undo_reference", "transaction", "tx_id", F.coalesce("reference_id", F.lit("none")))


def players_state(players: DataFrame) -> DataFrame:
    """Sold exactly if owner, price and sequence are there; otherwise owner and price are null."""
    full = F.col("team_id").isNotNull() & F.col("sale_price").isNotNull() & F.col("sequence").isNotNull()
    bare = F.col("team_id").isNull() & F.col("sale_price").isNull()
    bad = players.where(((F.col("status") == "sold") & ~full) | ((F.col("status") != "sold") & ~bare))
    return violation(bad, "sold_state", "player", "player_id", F.col("status"))


def sold_matches_sale(players: DataFrame, tx: DataFrame) -> DataFrame:
    """Each sold player and active sale agree on team, price and sequence, in both directions."""
    p = players.where("status = 'sold'").select("player_id", F.struct("team_id", F.col("sale_price").alias("price"), "sequence").alias("p"))
    t = tx.where("type = 'sale' and not reversed").select("player_id", F.struct("team_id", "price", "sequence").alias("t"))
    both = p.join(t, "player_id", "full_outer").where(~F.col("p").eqNullSafe(F.col("t")))
    return violation(both, "sale_mismatch", "player", "player_id", F.when(F.col("p").isNull(), "not sold").when(F.col("t").isNull(), "no sale").otherwise("differs"))


def valid_shape(teams: DataFrame, players: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Id patterns, names, money and enumerations."""
    ids = r"(?i)^[a-z0-9][a-z0-9_-]{1,47}$"
    states = ("available", "current", "sold", "unsold")
    t = teams.where(~F.coalesce(F.col("team_id").rlike(ids), F.lit(False)) | (F.trim(F.coalesce("name", F.lit(""))) == "") | ~F.coalesce(F.col("initial_purse") > 0, F.lit(False)))
    p = players.where(
        ~F.coalesce(F.col("player_id").rlike(ids), F.lit(False))
        | (F.trim(F.coalesce("name", F.lit(""))) == "")
        | ~F.coalesce(F.col("role").isin(*roles), F.lit(False))
        | ~F.coalesce(F.col("base_price") > 0, F.lit(False))
        | ~F.coalesce(F.col("status").isin(*states), F.lit(False))
    )
    return violation(t, "team_shape", "team", "team_id", F.col("name")).unionByName(violation(p, "player_shape", "player", "player_id", F.col("name")))


def sequence_bound(tx: DataFrame, sequence: int, cap: int = 10_000) -> DataFrame:
    """The ledger's counter is at least the largest sequence, and histories have a cap."""
    s = tx.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("top"), F.count("*").alias("n"))
    a = violation(s.where(F.col("top") > sequence), "sequence_behind", "settings", "top", F.lit(sequence))
    return a.unionByName(violation(s.where(F.col("n") > cap), "history_cap", "settings", "n", F.lit(cap)))


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
