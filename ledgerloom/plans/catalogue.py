"""Every operator as a named query over the analytic test schema: (spark, sf_dir) -> DataFrame. Whole tables, no subsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import integrity, ledger, report, roster
from ..sources import mapping as M
from ..streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Settings of the registered queries.
TIERS = [(100_000, 5_000), (200_000, 10_000), (300_000, 25_000), (None, 50_000)]
RULES = [("ECONOMY", 1, 40), ("LARGE", 2, 50), ("MEDIUM", 0, None), ("PROMO", 3, 0), ("SMALL", 0, 45), ("STANDARD", 5, 60)]
VIEWER = 7
DAY_MS = 86_400_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _finance(spark: SparkSession, d: str) -> DataFrame:
    return ledger.team_finance(M.teams(spark, d), ledger.active_sales(M.transactions(spark, d)))


@query
def team_finance(spark: SparkSession, d: str) -> DataFrame:
    return _finance(spark, d)


@query
def total_and_average_sale(spark: SparkSession, d: str) -> DataFrame:
    return ledger.sale_totals(ledger.active_sales(M.transactions(spark, d)))


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.status_counts(M.transactions(spark, d))


@query
def top_priced_with_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return roster.top_priced(M.players(spark, d), "role")


@query
def role_counts_pivot(spark: SparkSession, d: str) -> DataFrame:
    return roster.role_counts(M.squad_lines(spark, d), M.players(spark, d), M.ROLES)


@query
def role_composition(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "role string, min_count long, max_count long")
    return roster.role_composition(M.squad_lines(spark, d), M.players(spark, d), M.franchises(spark, d), rules)


@query
def squad_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = roster.squads(M.squad_lines(spark, d), M.players(spark, d), M.franchises(spark, d))
    return rows.where((F.col("role") == "PROMO") & roster.matches("bolt", "player_name", "role")).select("team_id", "team_name", "lot", "line", "player_id", "player_name", "role", "price")


@query
def eligible_players(spark: SparkSession, d: str) -> DataFrame:
    lines = M.squad_lines(spark, d)
    return lines.where(roster.eligible(F.col("status"), True)).select("lot", "line", "player_id", "status")


@query
def search_players(spark: SparkSession, d: str) -> DataFrame:
    return roster.search(M.players(spark, d), "RED w", role="SMALL")


@query
def search_players_category(spark: SparkSession, d: str) -> DataFrame:
    return roster.search(M.players(spark, d), "", category="Brand#11").select("player_id", "name", "role")


@query
def search_teams(spark: SparkSession, d: str) -> DataFrame:
    t = M.teams(spark, d)
    return t.where(roster.matches("build", "name", "team_id", "owner")).select("team_id", "name", "owner")


@query
def other_active_teams(spark: SparkSession, d: str) -> DataFrame:
    return M.teams(spark, d).where((F.col("initial_purse") > 0) & (F.col("team_id") != VIEWER)).select("team_id", "name")


@query
def distinct_categories(spark: SparkSession, d: str) -> DataFrame:
    return M.players(spark, d).where("category <> ''").select("category").distinct()


@query
def player_queue(spark: SparkSession, d: str) -> DataFrame:
    return roster.queue(M.players(spark, d), "LARGE")


@query
def recent_sales_all(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recent(M.transactions(spark, d), 6, True).select("sequence", "team_id", "price", "reversed")


@query
def recent_sales_active(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recent(M.transactions(spark, d), 8, False).select("sequence", "team_id", "price")


@query
def history_labelled(spark: SparkSession, d: str) -> DataFrame:
    return ledger.history(M.transactions(spark, d), M.teams(spark, d))


@query
def last_event_can_undo(spark: SparkSession, d: str) -> DataFrame:
    return ledger.last_can_undo(M.actions(spark, d), "actor", ["ts", "event_id"], F.col("action") == "purchase")


@query
def last_result_per_player(spark: SparkSession, d: str) -> DataFrame:
    return roster.last_result(M.squad_lines(spark, d))


@query
def bid_increment_tier(spark: SparkSession, d: str) -> DataFrame:
    tx = M.transactions(spark, d).where("price is not null")
    return tx.select("sequence", "price", ledger.increment_for(F.col("price"), ledger.tier_array(TIERS), 1000).alias("increment"))


@query
def next_min_bid_valid(spark: SparkSession, d: str) -> DataFrame:
    return ledger.bid_checks(M.actions(spark, d).where("action = 'click'"), "actor", ["ts", "event_id"], 100, 50)


@query
def running_purse_feasible(spark: SparkSession, d: str) -> DataFrame:
    return ledger.running_purse(M.transactions(spark, d), M.teams(spark, d))


@query
def final_report_rows(spark: SparkSession, d: str) -> DataFrame:
    lines, players, teams = M.squad_lines(spark, d), M.players(spark, d), M.franchises(spark, d)
    finance = ledger.team_finance(teams, lines.where("status = 'sold'"))
    return report.final_rows(roster.squads(lines, players, teams), finance, lines)


@query
def report_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.csv_lines(_finance(spark, d), ["team_id", "name", "initial_purse", "spent", "remaining"])


@query
def transactions_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.csv_lines(M.transactions(spark, d), ["sequence", "type", "team_id", "price", "note"])


@query
def spend_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    tx = M.transactions(spark, d).where("type = 'sale'")
    return ledger.reconcile(ledger.active_sales(tx), tx, "team_id")


@query
def squad_slots(spark: SparkSession, d: str) -> DataFrame:
    return roster.slots(_finance(spark, d), 3, 6)


@query
def violations_fk(spark: SparkSession, d: str) -> DataFrame:
    dim = M.teams(spark, d).where("owner <> 'MACHINERY'")
    return integrity.orphans(M.transactions(spark, d), "team_id", dim, "team_id", "sequence", "transaction")


@query
def violations_overspent(spark: SparkSession, d: str) -> DataFrame:
    return integrity.overspent(_finance(spark, d))


@query
def violations_duplicates(spark: SparkSession, d: str) -> DataFrame:
    lines = M.squad_lines(spark, d)
    sold = integrity.duplicates(lines.where("status = 'sold'"), ["player_id"], "active_sale")
    return sold.unionByName(integrity.duplicates(lines, ["lot", "line"], "line"))


@query
def violations_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tier lists made of the pool's rows, twenty or so each, by the rule for stored settings and by the one for new ones."""
    key = F.col("player_id")
    set_id = F.concat_ws("/", "category", F.floor(key / 500))
    up_to = F.when(key % 11 != 0, F.floor(key / 3) * 100 - (key % 7) * 150)
    tiers = M.players(spark, d).select(set_id.alias("set_id"), key.alias("tier_no"), up_to.alias("up_to"), (key % 13).alias("increment"))
    return integrity.tier_order(tiers).unionByName(integrity.tier_order(tiers, entered=True))


@query
def violations_transaction_fields(spark: SparkSession, d: str) -> DataFrame:
    """The ledger with its undo rows; some rows lose a field or get one too many."""
    k = F.col("pos")
    led = _with_undos(spark, d).select(
        "tx_id", F.when(k % 31 == 0, -k).otherwise(k).alias("sequence"), F.when(k % 37 == 0, "loan").otherwise(F.col("type")).alias("type"), F.when(k % 41 != 0, F.col("price")).alias("price"),
        F.when((k % 43 == 0) & (F.col("type") == "unsold"), 1).otherwise(F.col("team_id")).alias("team_id"), F.when(k % 47 != 0, F.lit(False)).alias("reversed"), F.when(k % 3 != 0, F.col("reference_id")).alias("reference_id"),
    )
    return integrity.transaction_fields(led)


def _with_undos(spark: SparkSession, d: str) -> DataFrame:
    """Reversed sales get an undo row; every seventh points ahead of itself, every eleventh nowhere."""
    tx = M.transactions(spark, d)
    sales = tx.select(F.concat(F.lit("t"), F.col("sequence")).alias("tx_id"), (2 * F.col("sequence")).alias("pos"), "type", "team_id", "price", F.lit(None).cast("string").alias("reference_id"))
    ref = F.when(F.col("sequence") % 7 == 0, F.col("sequence") + 1).when(F.col("sequence") % 11 == 0, F.lit(-1)).otherwise(F.col("sequence"))
    undo = tx.where("reversed").select(F.concat(F.lit("u"), F.col("sequence")).alias("tx_id"), (2 * F.col("sequence") + 1).alias("pos"), F.lit("undo").alias("type"), "team_id", "price", F.concat(F.lit("t"), ref).alias("reference_id"))
    return sales.unionByName(undo)


@query
def undo_reference_check(spark: SparkSession, d: str) -> DataFrame:
    return integrity.undo_references(_with_undos(spark, d))


@query
def active_sales_from_events(spark: SparkSession, d: str) -> DataFrame:
    return ledger.active_sales_by_events(_with_undos(spark, d)).groupBy("team_id").agg(F.count("*").alias("sales"), F.sum("price").alias("spend"))


@query
def retention_top_n(spark: SparkSession, d: str) -> DataFrame:
    return ledger.newest(M.actions(spark, d), "actor", [F.desc("ts"), F.desc("event_id")], 40).select("actor", "event_id", "age_rank")


@query
def clean_text_initials(spark: SparkSession, d: str) -> DataFrame:
    p = M.players(spark, d).select("player_id", F.concat(F.lit("\t "), F.col("name"), F.lit(" \x07")).alias("raw"), "name")
    return p.select("player_id", X.clean_text(F.col("raw")).alias("clean"), X.initials(F.col("name")).alias("initials"), X.escape_html(F.concat(F.lit("<"), F.col("name"), F.lit("&'\">"))).alias("escaped"))


@query
def parse_integer(spark: SparkSession, d: str) -> DataFrame:
    """Keys written in many ways: plain, spaced, grouped, signed, with exponents, fractions and other bases, and as text that is no number."""
    k = M.players(spark, d).select(F.col("player_id").alias("k"))
    t = F.col("k").cast("string")
    ways = [
        t, F.concat(F.lit(" \t"), t, F.lit(" ")), F.concat(t, F.lit(",000")), F.concat(F.lit("+"), t), F.concat(F.lit("-"), t), F.concat(t, F.lit("e3")), F.concat(t, F.lit(".0")), F.concat(t, F.lit(".5")),
        F.concat(F.lit("0x"), F.lower(F.hex("k"))), F.concat(F.lit("0b"), F.bin("k")), F.concat(F.lit("0X"), F.hex("k")), F.concat(F.lit("."), t), F.concat(t, F.lit(".")), F.lit(""), F.concat(F.lit("x"), t), F.concat(F.lit("900719925474"), F.lpad(t, 8, "0")),
    ]
    rows = k.select("k", F.get(F.array(*ways), (F.col("k") % len(ways)).cast("int")).alias("raw"))
    return rows.select("k", "raw", X.parse_integer(F.col("raw")).alias("number"), X.amount(F.col("raw")).alias("amount"))


@query
def money_grouping(spark: SparkSession, d: str) -> DataFrame:
    return _finance(spark, d).select("team_id", X.indian_grouping(F.col("remaining")).alias("money"), X.pad(F.col("purchased"), 3).alias("padded"))


@query
def role_alias(spark: SparkSession, d: str) -> DataFrame:
    raw = ["Batsman", " keeper ", "BOWLER", "all rounder", "Umpire", "", "Wicket-Keeper", "batswoman", "Wicket Keeper", "All-Rounder", "allrounder", "\tBatter"]
    rows = M.players(spark, d).select("player_id", F.get(F.array(*[F.lit(r) for r in raw]), (F.col("player_id") % len(raw)).cast("int")).alias("raw"))
    return rows.select("player_id", "raw", X.normal_role(F.col("raw")).alias("role"))


@query
def masked_view(spark: SparkSession, d: str) -> DataFrame:
    return roster.masked(_finance(spark, d), VIEWER)


@query
def session_validity(spark: SparkSession, d: str) -> DataFrame:
    return stateful.session_validity(M.actions(spark, d), "actor", "ts", F.col("action") == "signup")


@query
def rate_limit_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Window of 5 days and block of 24 hours, so that the sparse test log reaches the limit."""
    a = M.actions(spark, d).where("action in ('error', 'signup')")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = a.select(F.col("actor").cast("string").alias("key"), ms.alias("at_ms"), F.col("event_id").alias("seq"), (F.col("action") == "signup").alias("ok"))
    return stateful.limit_batch(rows, stateful.Limiter(5, 5 * DAY_MS, DAY_MS))


@query
def presence_intervals(spark: SparkSession, d: str) -> DataFrame:
    return stateful.presence(M.actions(spark, d), "actor", "ts", F.col("action") == "signup", F.col("action") == "error")


@query
def latest_version_wins(spark: SparkSession, d: str) -> DataFrame:
    a = M.actions(spark, d).select("actor", F.col("event_id").alias("version"), "action", "amount")
    late = a.where("version % 3 = 0").withColumn("version", F.col("version") - 1_000_000)
    return ledger.latest_version(a.unionByName(late), "actor", "version")


@query
def snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.snapshot_summary(M.teams(spark, d), M.transactions(spark, d))


@query
def device_labels(spark: SparkSession, d: str) -> DataFrame:
    """Connections with a label by role, team names where there are any."""
    a = M.actions(spark, d).where("action = 'view'")
    t = M.teams(spark, d).select(F.col("team_id").alias("_t"), "name")
    label = F.when(F.col("actor") % 10 == 0, "Admin").when(F.col("name").isNotNull(), F.concat(F.lit("Team: "), F.col("name"))).otherwise("Display")
    return a.join(t, (F.col("actor") * 11) == F.col("_t"), "left").select("event_id", "actor", label.alias("label"))


@query
def full_state_json(spark: SparkSession, d: str) -> DataFrame:
    return report.export_state(M.teams(spark, d).withColumn("pin_hash", F.lit("x")), ["pin_hash"])


@query
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    a = M.actions(spark, d)
    status = F.when(F.col("action") == "click", "live").when(F.col("action") == "view", "current").when(F.col("action") == "purchase", "sold").when(F.col("action") == "error", "").otherwise("Odd One!")
    state = F.when(F.col("event_id") % 5 == 0, "paused").otherwise("live")
    return a.select("event_id", X.status_text(status).alias("text"), X.status_class(status).alias("css"), X.headline(state, status).alias("headline"), X.currency(F.col("amount")).alias("money"))


@query
def display_times(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return M.actions(spark, d).select("event_id", X.date_time(ts).alias("shown"), X.date_time(ts, False).alias("clock"))


@query
def bid_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Bids to the view just before them: last value over the ordered log, instead of an as-of join."""
    from pyspark.sql import Window

    w = Window.partitionBy("actor").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = M.actions(spark, d).withColumn("selected", F.last(F.when(F.col("action") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return a.where("action = 'click'").select("event_id", "actor", "amount", "selected")


@query
def spend_rollup(spark: SparkSession, d: str) -> DataFrame:
    tx = M.transactions(spark, d).where("type = 'sale'")
    t = M.teams(spark, d).select("team_id", "owner")
    return tx.join(t, "team_id").rollup("owner", "reversed").agg(F.sum("price").alias("spend"), F.count("*").alias("sales"))


@query
def command_fold(spark: SparkSession, d: str) -> DataFrame:
    """Commands derived from the action log, one auction for each actor."""
    from ..streaming.fold import Settings, fold

    a = M.actions(spark, d)
    command = F.when(F.col("action") == "view", "player.select").when(F.col("action") == "click", "bid").when(F.col("action") == "purchase", "sell").when(F.col("action") == "signup", "unsold").otherwise("undo")
    log = a.select(F.col("actor").alias("event_id"), (F.col("event_id") + 100).alias("seq"), command.alias("command"), F.concat(F.lit("p"), F.col("event_id") % 20).alias("player_id"), F.when(F.col("action") == "click", F.concat(F.lit("t"), F.col("event_id") % 3)).alias("team_id"), F.when(F.col("action") == "click", F.col("amount") - F.col("amount") % 50).alias("amount"), F.lit(False).alias("override"))
    actors = a.select(F.col("actor").alias("event_id")).distinct()
    setup = F.array(
        *[F.struct(F.lit(i).cast("long").alias("seq"), F.lit("team.add").alias("command"), F.lit(None).cast("string").alias("player_id"), F.lit(f"t{i}").alias("team_id")) for i in range(3)],
        *[F.struct(F.lit(3 + i).cast("long").alias("seq"), F.lit("player.add").alias("command"), F.lit(f"p{i}").alias("player_id"), F.lit(None).cast("string").alias("team_id")) for i in range(20)],
        F.struct(F.lit(50).cast("long").alias("seq"), F.lit("start").alias("command"), F.lit(None).cast("string").alias("player_id"), F.lit(None).cast("string").alias("team_id")),
    )
    first = actors.select("event_id", F.explode(setup).alias("s")).select("event_id", "s.*").withColumns({"amount": F.lit(None).cast("long"), "override": F.lit(False)})
    return fold(first.unionByName(log), Settings(base_price=100, purse=50_000, step=50))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Players with the status, team, price and sequence of their latest line."""
    key = F.struct("ts", "lot", "line", "team_id", "price", "quantity")
    last = M.squad_lines(spark, d).groupBy(F.col("player_id").alias("_p")).agg(F.max_by(F.struct("status", "team_id", "price", "lot"), key).alias("l"))
    sold, status = F.col("l.status") == "sold", F.coalesce("l.status", F.lit("available"))
    out = M.players(spark, d).join(last, F.col("player_id") == F.col("_p"), "left")
    return out.select("player_id", "name", "role", "category", "base_price", status.alias("status"), F.when(sold, F.col("l.team_id")).alias("team_id"), F.when(sold, F.col("l.price")).alias("price"), F.when(status != "available", F.col("l.lot")).alias("sequence"))


@query
def player_table(spark: SparkSession, d: str) -> DataFrame:
    return roster.player_table(_pool(spark, d), status="available", sort="price").select("player_id", "name", "role", "base_price", "status")


@query
def player_table_filtered(spark: SparkSession, d: str) -> DataFrame:
    return roster.player_table(_pool(spark, d), "RED", "SMALL", status="sold", sort="role").select("player_id", "name", "role", "status", "team_id", "price")


@query
def squad_table(spark: SparkSession, d: str) -> DataFrame:
    return roster.squad_table(_pool(spark, d).where(f"status = 'sold' and team_id = {VIEWER}"), "price").select("player_id", "name", "role", "price", "sequence")


@query
def first_eligible(spark: SparkSession, d: str) -> DataFrame:
    return roster.first_eligible(_pool(spark, d), True).select("player_id", "name", "status")


@query
def player_team_labels(spark: SparkSession, d: str) -> DataFrame:
    return roster.with_team(_pool(spark, d), M.franchises(spark, d).where("team_id % 9 <> 0")).select("player_id", "status", "team_name")


@query
def players_csv(spark: SparkSession, d: str) -> DataFrame:
    p = _pool(spark, d).withColumnsRenamed({"player_id": "id", "base_price": "basePrice", "team_id": "teamId", "price": "salePrice"})
    return report.csv_lines(report.export_rows("players", p), list(report.HEADERS["players"]))


@query
def teams_csv(spark: SparkSession, d: str) -> DataFrame:
    owners = M.teams(spark, d).select(F.col("team_id").alias("_t"), "owner", (F.col("initial_purse") > 0).alias("active"))
    t = _finance(spark, d).join(owners, F.col("team_id") == F.col("_t")).withColumnsRenamed({"team_id": "id", "initial_purse": "initialPurse", "purchased": "playersPurchased"})
    return report.csv_lines(report.export_rows("teams", t), list(report.HEADERS["teams"]))


@query
def transactions_csv(spark: SparkSession, d: str) -> DataFrame:
    """A transaction's player is the lowest one of its lot's lines."""
    who = M.squad_lines(spark, d).groupBy(F.col("lot").alias("_lot")).agg(F.min("player_id").alias("playerId"))
    p = M.players(spark, d).select(F.col("player_id").alias("_p"), F.col("name").alias("playerName"), F.col("base_price").alias("basePrice"))
    t = M.teams(spark, d).select(F.col("team_id").alias("teamId"), F.col("name").alias("teamName"))
    tx = M.transactions(spark, d).join(who, F.col("sequence") == F.col("_lot"), "left").join(p, F.col("playerId") == F.col("_p"), "left").join(t, F.col("team_id") == F.col("teamId"), "left")
    tx = tx.withColumn("reversed", F.when(F.col("type") == "sale", F.col("reversed"))).withColumn("timestamp", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return report.csv_lines(report.export_rows("transactions", tx), list(report.HEADERS["transactions"]))


@query
def report_csv(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the report with the keys of their order."""
    teams = M.franchises(spark, d)
    sold = _pool(spark, d).where("status = 'sold'")
    squads = sold.withColumnsRenamed({"name": "player_name"}).withColumn("pos", F.col("player_id")).join(teams.select("team_id", F.col("name").alias("team_name")), "team_id")
    unsold = _pool(spark, d).where("status = 'unsold'").withColumnsRenamed({"name": "player_name"}).withColumn("pos", F.col("player_id"))
    rows = report.report_rows(squads, ledger.team_finance(teams, sold), unsold)
    cells = F.concat_ws(",", *[report.csv_cell(F.col(c)) for c in report.HEADERS["report"]])
    return rows.select("part", "team_pos", "pos", cells.alias("line"))


@query
def report_json(spark: SparkSession, d: str) -> DataFrame:
    pool, t = _pool(spark, d), M.franchises(spark, d)
    sold = pool.where("status = 'sold'")
    extra = t.select(F.col("team_id").alias("_t"), F.lit("").alias("owner"), (F.col("initial_purse") > 0).alias("active"))
    teams = ledger.team_finance(t, sold).join(extra, F.col("team_id") == F.col("_t")).drop("_t")
    squads = sold.withColumnsRenamed({"name": "player_name"}).withColumn("pos", F.col("player_id"))
    header = {"name": "Cup", "status": "completed", "currencySymbol": "₹", "generatedAt": "2024-01-01T00:00:00.000Z"}
    return report.report_json(header, teams, squads, pool, sold, M.transactions(spark, d).select("sequence", "type", "team_id", "price", "reversed"), M.ROLES)


@query
def first_devices(spark: SparkSession, d: str) -> DataFrame:
    """The first eight connections; a limit is the feature."""
    a = M.actions(spark, d).where("action = 'view'").orderBy("ts", "event_id").limit(8)
    t = M.teams(spark, d).select(F.col("team_id").alias("_t"), "name")
    role = F.when(F.col("actor") % 10 == 0, "admin").when(F.col("actor") % 3 == 0, "team").otherwise("display")
    out = a.withColumn("role", role).join(t, (F.col("role") == "team") & (F.col("actor") * 11 == F.col("_t")), "left")
    label = F.when(F.col("role") == "admin", "Administrator").when(F.col("role") == "team", F.coalesce("name", F.lit("Team dashboard"))).otherwise("Public display")
    return out.select("event_id", "role", label.alias("label"))


@query
def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    return M.transactions(spark, d).select("sequence", X.derived_id("tx", F.col("sequence"), F.col("type")).alias("tx_id"))


@query
def public_view(spark: SparkSession, d: str) -> DataFrame:
    """Everybody sees the money; a pin is needed where a team has one."""
    return roster.masked(_finance(spark, d).withColumn("has_pin", F.col("team_id") % 4 == 0), None, show_others=True)


def _viewers(spark: SparkSession, d: str) -> DataFrame:
    """A viewer for each nation, of one owner group each: administrators, teams and the public."""
    n = M.read(spark, d, "nation")
    key = F.get(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), F.col("n_nationkey") % 5)
    role = F.when(F.col("n_regionkey") == 0, "admin").when(F.col("n_regionkey") == 1, "display").otherwise("team")
    return n.select(F.col("n_nationkey").alias("viewer_id"), key.alias("key"), role.alias("role"), F.when(role == "team", F.col("n_nationkey").cast("long")).alias("viewer_team"))


@query
def masked_feed(spark: SparkSession, d: str) -> DataFrame:
    owners = M.teams(spark, d).select(F.col("team_id").alias("_t"), F.col("owner").alias("key"))
    rows = _finance(spark, d).join(owners, F.col("team_id") == F.col("_t")).select("key", "team_id", "initial_purse", "spent", "remaining", "purchased")
    return stateful.masked_for(rows, _viewers(spark, d), ("initial_purse", "spent", "remaining", "purchased"))


@query
def reconnect_replay(spark: SparkSession, d: str) -> DataFrame:
    a = M.actions(spark, d).select(F.col("actor").alias("key"), F.col("event_id").alias("version"), "action", "amount")
    readers = a.select("key").distinct().select(F.concat(F.lit("r"), F.col("key")).alias("reader_id"), "key", F.when(F.col("key") % 3 != 0, F.when(F.col("key") % 7 == 0, F.lit(1 << 40)).otherwise(F.col("key"))).alias("seen"))
    return stateful.replay(a, readers)


@query
def active_team_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = stateful.session_validity(M.actions(spark, d), "actor", "ts", F.col("action") == "signup").where("valid").select("event_id", F.col("actor").alias("team_id"))
    return stateful.active_sessions(s, M.teams(spark, d).withColumn("active", F.col("initial_purse") > 0))


@query
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    """Action names, sizes, tiers, switches and cookies as they are shown or read."""
    k = F.col("event_id")
    token = F.get(F.array(*[F.lit(x) for x in ("true", " YES ", "1", "", "False", "no", "0", "perhaps")]), (k % 8).cast("int"))
    tier = X.parse_tiers(F.concat(k, F.lit(",000: 50\n\n*: "), k))
    jar = X.cookies(F.concat(F.lit("a=first; session="), k, F.lit("%20x; a="), F.col("action"), F.lit("; bad=%zz; none")))
    return M.actions(spark, d).select(
        "event_id", X.action_text(F.concat(F.col("action"), F.lit(".was_done"))).alias("action_text"), X.size_kb(k * 512).alias("size"), X.parse_boolean(token).alias("switch"),
        F.array_join(F.transform(tier, lambda t: X.tier_text(t["up_to"], t["increment"])), "|").alias("tiers"), F.concat_ws("|", jar["session"], jar["a"], jar["bad"]).alias("jar"),
    )


@query
def csv_team_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Team files, one for each owner group: ids and names repeat, and a row refused for its name leaves its id free."""
    from ..sources import csv_ingest as C

    t, k = M.teams(spark, d), F.col("team_id")
    cells = [F.concat(F.lit("T-"), k % 700), F.concat(F.lit("Name "), F.floor(k / 2) % 400), F.when(k % 17 == 0, "").otherwise((k * 100).cast("string")), F.when(k % 19 == 0, "perhaps").when(k % 2 == 0, "no").otherwise("")]
    line = t.select("owner", "team_id", F.concat_ws(",", *[report.csv_cell(c) for c in cells]).alias("line"))
    body = line.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("team_id", "line"))).alias("rows"))
    files = body.select(F.col("owner").alias("path"), F.concat(F.lit("id,name,purse,active\r\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n")).alias("text"))
    known = spark.createDataFrame([("t-9", "name 33")], "team_id string, name string")
    out = C.preview_teams(C.read_records(spark, files, C.TEAM_COLUMNS), known)
    return out.select("path", "line", "team_id", "name", "initial_purse", "active", "error")


@query
def csv_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The pool as one CSV text a category, parsed, bound and checked again."""
    from ..sources import csv_ingest as C

    p = M.players(spark, d)
    role = F.when(F.col("role").isin("ECONOMY", "SMALL"), "Batsman").when(F.col("role") == "LARGE", "bowler").when(F.col("role") == "PROMO", "Umpire").otherwise("Keeper")
    line = p.select("category", "player_id", F.concat_ws(",", report.csv_cell(F.concat(F.lit("P-"), F.col("player_id") % 1500)), report.csv_cell(F.col("name")), report.csv_cell(role), report.csv_cell(F.col("base_price"))).alias("line"))
    body = line.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("player_id", "line"))).alias("rows"))
    files = body.select(F.col("category").alias("path"), F.concat(F.lit("id,name,role,basePrice\r\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n")).alias("text"))
    recs = C.read_records(spark, files, C.PLAYER_COLUMNS)
    pool = spark.createDataFrame([("p-7",), ("p-8",)], "player_id string")
    return C.preview_players(recs, pool).select("path", "line", "player_id", "name", "role", "base_price", "error")
