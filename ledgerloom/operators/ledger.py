"""Budgets, sales and history over an append-only ledger.

Team aggregates are single grouped aggregations with map-side combination that are joined to the team dimension; nothing is recomputed per
team. Order is explicit: ``sequence`` for transactions, ids for ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_active_sale(prefix: str = "") -> Column:
    return (F.col(f"{prefix}type") == "sale") & ~F.col(f"{prefix}reversed")


def active_sales(tx: DataFrame) -> DataFrame:
    """Sales that no reversal flag has taken back."""
    return tx.where(is_active_sale())


def active_sales_by_events(tx: DataFrame) -> DataFrame:
    """The same from events alone: sales that no undo row refers to."""
    undone = tx.where("type = 'undo'").select(F.col("reference_id").alias("_ref"))
    return tx.where("type = 'sale'").join(undone, F.col("tx_id") == F.col("_ref"), "left_anti")


def team_finance(teams: DataFrame, sales: DataFrame) -> DataFrame:
    """spent, remaining and number of purchases of every team, with zeros for teams without one."""
    spent = sales.groupBy(F.col("team_id").alias("_team")).agg(F.sum("price").alias("_spent"), F.count("*").alias("_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = teams.join(spent, F.col("team_id") == F.col("_team"), "left")
    return out.select("team_id", "name", "initial_purse", zero("_spent").alias("spent"), (F.col("initial_purse") - zero("_spent")).alias("remaining"), zero("_n").alias("purchased"))


def sale_totals(sales: DataFrame) -> DataFrame:
    """Total and average price; halves round up; zeros for an empty ledger."""
    n, total = F.count("*"), F.coalesce(F.sum("price"), F.lit(0))
    return sales.agg(n.alias("sales"), total.alias("total_spend"), F.when(n == 0, F.lit(0).cast("long")).otherwise(F.floor(total / n + F.lit(0.5))).alias("average_price"))


def status_counts(tx: DataFrame) -> DataFrame:
    """All counts in one pass."""
    return tx.agg(
        F.count_if(is_active_sale()).alias("sold"),
        F.count_if((F.col("type") == "sale") & F.col("reversed")).alias("reversed"),
        F.count_if(F.col("type") == "unsold").alias("unsold"),
        F.countDistinct("team_id").alias("active_teams"),
        F.coalesce(F.max("sequence"), F.lit(0)).alias("max_sequence"),
    )


def recent(tx: DataFrame, limit: int, reversed_too: bool) -> DataFrame:
    """Newest sales first. A limit is the feature; ties go to the higher sequence."""
    sales = tx.where("type = 'sale'")
    return (sales if reversed_too else active_sales(sales)).orderBy(F.desc("ts"), F.desc("sequence")).limit(limit)


def transaction_label() -> Column:
    return F.when((F.col("type") == "sale") & F.col("reversed"), "Reversed sale").when(F.col("type") == "sale", "Sold").when(F.col("type") == "undo", "Undo").otherwise("Unsold")


def history(tx: DataFrame, teams: DataFrame) -> DataFrame:
    """Every transaction with a label and a team name, or a dash."""
    names = teams.select(F.col("team_id").alias("_team"), F.col("name").alias("_name"))
    out = tx.join(names, F.col("team_id") == F.col("_team"), "left")
    return out.select("sequence", transaction_label().alias("label"), F.coalesce("_name", F.lit("—")).alias("team_name"), F.col("price"))


def last_can_undo(log: DataFrame, key: str, order: list[str], sale: Column) -> DataFrame:
    """The last action of each key, and whether it is a sale that may be undone. ``max_by`` needs no sort."""
    last = F.max_by(F.struct("event_id", "action", sale.alias("_sale")), F.struct(*order))
    return log.groupBy(key).agg(last.alias("l")).select(key, F.col("l.event_id").alias("last_event"), F.col("l.action").alias("last_action"), F.col("l._sale").alias("can_undo"))


def running_purse(tx: DataFrame, teams: DataFrame) -> DataFrame:
    """Each sale against what its team had left just before it."""
    before = Window.partitionBy("team_id").orderBy("ts", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    sales = active_sales(tx).withColumn("spent_before", F.coalesce(F.sum("price").over(before), F.lit(0)).cast("long"))
    purse = teams.select(F.col("team_id").alias("_team"), "initial_purse")
    left = F.col("initial_purse") - F.col("spent_before")
    return sales.join(purse, F.col("team_id") == F.col("_team")).select("sequence", "team_id", "price", left.alias("remaining_before"), (F.col("price") <= left).alias("feasible"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two sources of spend side by side; rows where they differ."""
    x, y = a.groupBy(key).agg(F.sum("price").alias("spend_a")), b.groupBy(key).agg(F.sum("price").alias("spend_b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = x.join(y, key, "full_outer").select(key, zero("spend_a").alias("spend_a"), zero("spend_b").alias("spend_b"))
    return out.withColumn("difference", F.col("spend_a") - F.col("spend_b")).where("difference <> 0")


def increment_for(price: Column, tiers: Column, default: int) -> Column:
    """Increment of the first tier whose ceiling isn't below the price; open tiers have a null ceiling."""
    fit = F.filter(tiers, lambda t: t["up_to"].isNull() | (price <= t["up_to"]))
    return F.coalesce(F.get(fit, F.lit(0))["increment"], F.lit(default).cast("long"))


def tier_array(tiers: list[tuple[int | None, int]]) -> Column:
    """At most a handful of tiers: a literal array in the plan."""
    if not tiers:
        return F.array().cast("array<struct<up_to:bigint,increment:bigint>>")
    return F.array(*[F.struct(F.lit(u).cast("long").alias("up_to"), F.lit(i).cast("long").alias("increment")) for u, i in tiers])


def bid_checks(bids: DataFrame, key: str, order: list[str], base: int, step: int) -> DataFrame:
    """Each bid against the highest before it: minimum, step rule, verdict."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    high = F.max("amount").over(before)
    rows = bids.withColumn("highest", high).withColumn("minimum", F.coalesce(F.col("highest") + step, F.lit(base)).cast("long"))
    beats = F.col("highest").isNull() | (F.col("amount") > F.col("highest"))
    valid = (F.col("amount") >= F.col("minimum")) & ((F.col("amount") - F.col("minimum")) % step == 0) & beats
    return rows.select("event_id", key, "amount", "highest", "minimum", beats.alias("beats_highest"), valid.alias("valid"))


def newest(df: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """Retention: the newest ``keep`` rows of each key."""
    return df.withColumn("age_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("age_rank") <= keep)


def latest_version(snapshots: DataFrame, key: str, version: str) -> DataFrame:
    """Late and out-of-order snapshots lose against the highest version of their key."""
    cols = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in cols])
