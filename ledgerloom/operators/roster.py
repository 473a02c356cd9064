"""Squads, role composition, eligibility and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_counts(lines: DataFrame, players: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """One zero-filled column for each role. The value list is given, so the pivot needs no extra job."""
    joined = lines.where("status = 'sold'").join(players.select("player_id", "role"), "player_id")
    return joined.groupBy("team_id").pivot("role", list(roles)).count().na.fill(0, list(roles))


def role_composition(lines: DataFrame, players: DataFrame, teams: DataFrame, rules: DataFrame) -> DataFrame:
    """Each team and role against its rule (role, min_count, max_count; a maximum of 0 or null is open)."""
    have = lines.where("status = 'sold'").join(players.select("player_id", "role"), "player_id").groupBy("team_id", F.lower("role").alias("role_key")).agg(F.count("*").alias("count"))
    grid = teams.select("team_id").crossJoin(F.broadcast(rules))  # rules: a row for each role, a handful by definition
    rows = grid.withColumn("role_key", F.lower("role")).join(have, ["team_id", "role_key"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    cap = F.coalesce(F.nullif(F.col("max_count"), F.lit(0)), F.greatest("min_count", "count", F.lit(1))).cast("long")
    rows = rows.withColumn("cap", cap)
    pct = F.least(F.lit(100), F.floor(F.col("count") * 100 / F.col("cap") + F.lit(0.5))).cast("long")
    ok = (F.col("max_count").isNull() | (F.col("count") <= F.col("max_count"))) & (F.col("count") >= F.col("min_count"))
    return rows.select("team_id", "role", "count", "cap", pct.alias("pct"), ok.alias("ok"))


def squads(lines: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    sold = lines.where("status = 'sold'")
    return sold.join(players.select("player_id", F.col("name").alias("player_name"), "role"), "player_id").join(teams.select("team_id", F.col("name").alias("team_name")), "team_id")


def eligible(status: Column, reintroduce: bool) -> Column:
    return (status == "available") | ((status == "unsold") & F.lit(reintroduce))


def matches(query: str, *cols: str) -> Column:
    """Case-insensitive substring of the concatenated columns; an empty query matches all."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])), F.lit(query.lower()))


def search(players: DataFrame, query: str, role: str = "all", category: str = "all") -> DataFrame:
    """'all' switches a predicate off."""
    out = players.where(matches(query, "player_id", "name", "role", "category"))
    if role != "all":
        out = out.where(F.col("role") == role)
    return out if category == "all" else out.where(F.col("category") == category)


def top_priced(players: DataFrame, by: str) -> DataFrame:
    """The dearest of each group; ties to the lowest id. ``max_by`` instead of a sort."""
    best = F.max_by(F.struct("player_id", "name", "base_price"), F.struct(F.col("base_price"), -F.col("player_id")))
    return players.groupBy(by).agg(best.alias("b")).select(by, F.col("b.player_id").alias("player_id"), F.col("b.name").alias("name"), F.col("b.base_price").alias("base_price"))


def in_order(rows: DataFrame, by: str, price: str, dearest_first: bool = False) -> DataFrame:
    """Rows by 'price', 'role' (then name) or 'name'; names and roles in the order of a dictionary, not of code units, and ties in pool order."""
    word = lambda c: F.collate(F.col(c), "UNICODE")
    keys = {"price": [F.desc(price) if dearest_first else F.asc(price)], "role": [word("role"), word("name")], "name": [word("name")]}[by]
    return rows.orderBy(*keys, "player_id")


def player_table(players: DataFrame, query: str = "", role: str = "all", category: str = "all", status: str = "all", reintroduce: bool = True, sort: str = "name") -> DataFrame:
    """The pool's table: text search, role, category and status ('available' means eligible), sorted; prices go up."""
    out = search(players, query, role, category)
    if status == "available":
        out = out.where(eligible(F.col("status"), reintroduce))
    elif status != "all":
        out = out.where(F.col("status") == status)
    return in_order(out, sort, "base_price")


def squad_table(squad: DataFrame, sort: str = "name") -> DataFrame:
    """One team's squad, sorted; prices go down."""
    return in_order(squad, sort, "price", dearest_first=True)


def first_eligible(players: DataFrame, reintroduce: bool) -> DataFrame:
    """Who is up next: the first eligible player in pool order, or no row."""
    return players.where(eligible(F.col("status"), reintroduce)).orderBy("player_id").limit(1)


def queue(players: DataFrame, role: str, width: int = 10_000) -> DataFrame:
    """Rank in id order with a zero-padded label that never truncates. Ids are ranked within ranges of ``width`` and added to the count of the ranges
    before, so no task ranks the whole queue."""
    rows = players.where(F.col("role") == role).withColumn("_range", F.floor(F.col("player_id") / width))
    # one row for each range
    before = F.sum("_n").over(Window.partitionBy("role").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy("role", F.col("_range").alias("_from")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0).cast("long"))).select("_from", "_before")
    own = F.row_number().over(Window.partitionBy("_range").orderBy("player_id"))
    ranked = rows.withColumn("_own", own).join(ranges, F.col("_range") == F.col("_from")).select("player_id", "name", (F.col("_own") + F.col("_before")).alias("rank"))
    text = F.col("rank").cast("string")
    return ranked.select("player_id", "name", "rank", F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text).alias("label"))


def with_team(players: DataFrame, teams: DataFrame) -> DataFrame:
    """Every player with its team's name, 'Team' where the team isn't known and a dash where there is none."""
    names = teams.select(F.col("team_id").alias("_t"), F.col("name").alias("_name"))
    out = players.join(names, F.col("team_id") == F.col("_t"), "left")
    return out.select(*players.columns, F.when(F.col("team_id").isNull(), "—").otherwise(F.coalesce("_name", F.lit("Team"))).alias("team_name"))


def slots(finance: DataFrame, min_squad: int, max_squad: int | None) -> DataFrame:
    left = F.greatest(F.lit(0), F.lit(max_squad) - F.col("purchased")).cast("long") if max_squad is not None else F.lit(None).cast("long")
    text = left.cast("string") if max_squad is not None else F.lit("Flexible")
    return finance.select("team_id", "purchased", left.alias("slots_left"), text.alias("slots_text"), (min_squad - F.col("purchased")).cast("long").alias("shortfall"))


def last_result(lines: DataFrame) -> DataFrame:
    """The latest line of each player; all columns break ties."""
    key = F.struct("ts", "lot", "line", "team_id", "price", "quantity")
    return lines.groupBy("player_id").agg(F.max_by(F.struct("lot", "line", "status"), key).alias("l")).select("player_id", F.col("l.lot").alias("lot"), F.col("l.line").alias("line"), F.col("l.status").alias("status"))


def masked(finance: DataFrame, viewer_team: int | None, admin: bool = False, show_others: bool = False, require_pin: bool = False) -> DataFrame:
    """Money and number of purchases only for those who may see them; the rest reads null. A pin is needed where the rules ask for one, where others' money is
    hidden, or where the team has one (``has_pin``)."""
    own = F.col("team_id") == viewer_team if viewer_team is not None else F.lit(False)
    expose = F.lit(admin) | F.lit(show_others) | own
    cols = [F.when(expose, F.col(c)).alias(c) for c in ("initial_purse", "spent", "remaining", "purchased")]
    has = F.coalesce(F.col("has_pin"), F.lit(False)) if "has_pin" in finance.columns else F.lit(False)
    return finance.select("team_id", "name", *cols, (F.lit(require_pin or not show_others) | has).alias("pin_required"))
