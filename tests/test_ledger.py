"""Ledger, roster, report and integrity operators on small hand-made ledgers, the empty one too."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import integrity, ledger, report, roster

TX = "tx_id string, sequence long, pos long, ts timestamp, type string, reversed boolean, team_id string, player_id string, price long, reference_id string"
TEAMS = "team_id string, name string, owner string, initial_purse long"
PLAYERS = "player_id string, name string, role string, category string, base_price long, status string, team_id string, sale_price long, sequence long"


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([("t1", "Reds", "ann", 1000), ("t2", "Blues", "bo", 1000), ("t3", "Idle", "cy", 500)], TEAMS)


@pytest.fixture(scope="module")
def tx(spark):
    rows = [
        ("a", 1, 1, None, "sale", True, "t1", "p1", 400, None),
        ("b", 2, 2, None, "undo", False, "t1", "p1", 400, "a"),
        ("c", 3, 3, None, "sale", False, "t2", "p1", 450, None),
        ("d", 4, 4, None, "unsold", False, None, "p2", None, None),
        ("e", 5, 5, None, "sale", False, "t2", "p3", 600, None),
    ]
    return spark.createDataFrame(rows, TX)


def test_finance(teams, tx):
    got = {r["team_id"]: (r["spent"], r["remaining"], r["purchased"]) for r in ledger.team_finance(teams, ledger.active_sales(tx)).collect()}
    assert got == {"t1": (0, 1000, 0), "t2": (1050, -50, 2), "t3": (0, 500, 0)}
    assert [r["key"] for r in integrity.overspent(ledger.team_finance(teams, ledger.active_sales(tx))).collect()] == ["t2"]


def test_flag_and_events_agree(tx):
    ids = lambda df: sorted(r["tx_id"] for r in df.collect())
    assert ids(ledger.active_sales(tx)) == ids(ledger.active_sales_by_events(tx)) == ["c", "e"]


def test_empty_ledger(spark, teams, tx):
    none = tx.limit(0)
    assert tuple(ledger.sale_totals(none).first()) == (0, 0, 0)
    assert tuple(ledger.status_counts(none).first()) == (0, 0, 0, 0, 0)
    assert ledger.team_finance(teams, none).agg(F.sum("spent")).first()[0] == 0
    assert ledger.reconcile(none, none, "team_id").collect() == []


def test_average_rounds_halves_up(spark):
    rows = spark.createDataFrame([(1,), (2,)], "price long")
    assert ledger.sale_totals(rows).first()["average_price"] == 2


@pytest.mark.parametrize(("price", "want"), [(99, 5), (100, 5), (101, 10), (200, 10), (201, 7)])
def test_tier_bounds(spark, price, want):
    tiers = ledger.tier_array([(100, 5), (200, 10)])
    assert spark.range(1).select(ledger.increment_for(F.lit(price), tiers, 7).alias("x")).first()["x"] == want
    assert spark.range(1).select(ledger.increment_for(F.lit(price), ledger.tier_array([(100, 5), (None, 9)]), 7).alias("x")).first()["x"] == (5 if price <= 100 else 9)
    assert spark.range(1).select(ledger.increment_for(F.lit(price), ledger.tier_array([]), 7).alias("x")).first()["x"] == 7


def test_ties_go_to_the_lowest_id(spark):
    p = spark.createDataFrame([(2, "b", "x", 9), (1, "a", "x", 9), (3, "c", "x", 8)], "player_id long, name string, role string, base_price long")
    assert roster.top_priced(p, "role").first()["player_id"] == 1


def test_roles_at_their_bounds(spark):
    lines = spark.createDataFrame([("t1", i, "sold") for i in range(4)] + [("t1", 9, "unsold")], "team_id string, player_id long, status string")
    players = spark.createDataFrame([(i, "Batter" if i < 3 else "Bowler") for i in range(10)], "player_id long, role string")
    teams = spark.createDataFrame([("t1",), ("t2",)], "team_id string")
    rules = spark.createDataFrame([("Batter", 1, 3), ("Bowler", 2, None), ("Keeper", 0, 0)], "role string, min_count long, max_count long")
    got = {(r["team_id"], r["role"]): (r["count"], r["cap"], r["pct"], r["ok"]) for r in roster.role_composition(lines, players, teams, rules).collect()}
    assert got["t1", "Batter"] == (3, 3, 100, True)
    assert got["t1", "Bowler"] == (1, 2, 50, False)
    assert got["t2", "Keeper"] == (0, 1, 0, True)
    assert roster.role_counts(lines, players, ("Batter", "Bowler", "Keeper")).first().asDict() == {"team_id": "t1", "Batter": 3, "Bowler": 1, "Keeper": 0}


def test_sorts(spark):
    """Names in the order of a dictionary; prices up in the pool and down in a squad; ties in pool order."""
    rows = [(1, "b", "Bowler", 5), (2, "a", "bowler", 7), (3, "B", "Bowler", 5), (4, "é", "Batter", 1), (5, "_x", "Batter", 9), (6, "10", "Batter", 7), (7, "e", "Batter", 0), (8, "9", "Batter", 3)]
    p = spark.createDataFrame(rows, "player_id long, name string, role string, base_price long").withColumns({"category": F.lit(""), "status": F.lit("available"), "price": F.col("base_price")})
    ids = lambda df: [r["player_id"] for r in df.collect()]
    assert ids(roster.player_table(p)) == [5, 6, 8, 2, 1, 3, 7, 4]
    assert ids(roster.player_table(p, sort="price")) == [7, 4, 8, 1, 3, 2, 6, 5]
    assert ids(roster.squad_table(p, "price")) == [5, 2, 6, 1, 3, 8, 4, 7]
    assert ids(roster.player_table(p, sort="role"))[:5] == [5, 6, 8, 7, 4]
    mixed = p.withColumn("status", F.when(F.col("player_id") < 3, "sold").when(F.col("player_id") < 6, "unsold").otherwise("available"))
    assert sorted(ids(roster.player_table(mixed, status="available", reintroduce=False))) == [6, 7, 8]
    assert sorted(ids(roster.player_table(mixed, status="available"))) == [3, 4, 5, 6, 7, 8] and sorted(ids(roster.player_table(mixed, status="sold"))) == [1, 2]
    assert ids(roster.first_eligible(mixed, True)) == [3] and ids(roster.first_eligible(mixed, False)) == [6] and ids(roster.first_eligible(mixed.limit(0), True)) == []


def test_queue_ranks_across_ranges(spark):
    p = spark.range(1, 400).where("id % 3 <> 0").select(F.col("id").alias("player_id"), F.lit("n").alias("name"), F.lit("x").alias("role"))
    got = [(r["player_id"], r["rank"], r["label"]) for r in roster.queue(p, "x", width=7).orderBy("rank").collect()]
    ids = [i for i in range(1, 400) if i % 3]
    assert got == [(i, k, str(k).zfill(3)) for k, i in enumerate(ids, 1)]


def test_tiers(spark):
    t = spark.createDataFrame([("a", 1, 100, 1), ("a", 2, None, 1), ("a", 3, 50, 1), ("b", 1, 1, 0), ("c", 1, 5, 1), ("c", 2, None, 1), ("d", 1, 9, 1), ("d", 2, 5, 1), ("d", 3, 7, 1)], "set_id string, tier_no int, up_to long, increment long")
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(integrity.tier_order(t)) == ["a/3", "b/1", "d/2", "d/3"]
    assert keys(integrity.tier_order(t, entered=True)) == ["a/2", "a/3", "b/1", "d/2", "d/3"]


def test_transaction_fields(spark):
    rows = [("a", 1, "sale", "t", 5, False, None), ("b", 2, "sale", None, 5, False, None), ("c", 3, "sale", "t", 0, False, None), ("d", 4, "sale", "t", 5, None, None), ("e", 5, "unsold", "t", None, None, None), ("f", 6, "undo", "t", 5, None, "a"), ("g", 7, "undo", None, None, None, None), ("h", 0, "unsold", None, None, None, None), ("i", 9, None, None, None, None, None)]
    tx = spark.createDataFrame(rows, "tx_id string, sequence long, type string, team_id string, price long, reversed boolean, reference_id string")
    assert {r["key"]: r["detail"] for r in integrity.transaction_fields(tx).collect()} == {"b": "sale", "c": "sale", "d": "sale", "e": "unsold", "g": "undo", "h": "sequence", "i": "type"}


def test_search_and_eligibility(spark):
    p = spark.createDataFrame([("p1", "Ann Lee", "Batter", None), ("p2", "Bo", "Bowler", "A")], "player_id string, name string, role string, category string")
    ids = lambda df: sorted(r["player_id"] for r in df.collect())
    assert ids(roster.search(p, "ann")) == ["p1"] and ids(roster.search(p, "")) == ["p1", "p2"] and ids(roster.search(p, "", category="A")) == ["p2"]
    s = spark.createDataFrame([("available",), ("unsold",), ("sold",), ("current",)], "s string")
    assert s.where(roster.eligible(F.col("s"), True)).count() == 2 and s.where(roster.eligible(F.col("s"), False)).count() == 1


def test_masking(teams, tx):
    f = ledger.team_finance(teams, ledger.active_sales(tx))
    seen = lambda **k: {r["team_id"] for r in roster.masked(f, **k).collect() if r["remaining"] is not None}
    assert seen(viewer_team=None) == set() and seen(viewer_team="t2") == {"t2"}
    assert seen(viewer_team=None, admin=True) == seen(viewer_team=None, show_others=True) == {"t1", "t2", "t3"}


def test_pins(teams, tx):
    f = ledger.team_finance(teams, ledger.active_sales(tx)).withColumn("has_pin", F.col("team_id") == "t1")
    need = lambda **k: {r["team_id"] for r in roster.masked(f, None, **k).collect() if r["pin_required"]}
    assert need(show_others=True) == {"t1"} and need() == need(show_others=True, require_pin=True) == {"t1", "t2", "t3"}
    assert all(r["purchased"] is None for r in roster.masked(f, None).collect())


def test_slots(spark):
    f = spark.createDataFrame([("t", 7)], "team_id string, purchased long")
    assert tuple(roster.slots(f, 3, 6).first())[2:] == (0, "0", -4)
    assert roster.slots(f, 3, None).first()["slots_text"] == "Flexible"


def test_violations(spark, teams, tx):
    players = spark.createDataFrame(
        [("p1", "A", "Batter", "x", 1, "sold", "t2", 450, 3), ("p2", "B", "Bowler", "x", 1, "unsold", None, None, None), ("p3", "C", "Batter", "x", 1, "sold", "t2", 601, 5), ("p4", "D", "Batter", "x", 1, "sold", None, None, None), ("P 5", " ", "Umpire", "x", 0, "lost", None, None, None)],
        PLAYERS,
    )
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(integrity.sold_matches_sale(players, tx)) == ["p3", "p4"]
    assert keys(integrity.players_state(players)) == ["p4"]
    assert keys(integrity.valid_shape(teams, players, ("Batter", "Bowler"))) == ["P 5"]
    assert keys(integrity.undo_references(tx)) == []
    late = spark.createDataFrame([("u", 9, 0, None, "undo", False, None, None, None, "a"), ("v", 10, 10, None, "undo", False, None, None, None, "zz")], TX)
    assert keys(integrity.undo_references(tx.unionByName(late))) == ["u", "v"]
    assert {r["check_id"] for r in integrity.sequence_bound(tx, 4, 3).collect()} == {"sequence_behind", "history_cap"}
    assert integrity.sequence_bound(tx, 5).collect() == []
    assert keys(integrity.orphans(tx, "team_id", teams.where("team_id <> 't2'"), "team_id", "tx_id", "transaction")) == ["c", "e"]
    assert integrity.report([integrity.players_state(players), integrity.undo_references(late)]).count() == 3


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame([('=1+1', None, 'say "hi"', "-3", "plain")], "a string, b string, c string, d string, e string")
    assert report.csv_lines(df, list("abcde")).first()["line"] == '"\'=1+1","","say ""hi""","\'-3","plain"'
    report.write_csv(df, str(tmp_path / "out"), list("abcde"))
    assert exported(tmp_path / "out") == '\ufeff"a","b","c","d","e"\r\n"\'=1+1","","say ""hi""","\'-3","plain"\r\n'


def exported(folder):
    """All parts in the order of their names."""
    return "".join(p.read_bytes().decode() for p in sorted(folder.glob("part-*")))


def test_csv_export_of_many_parts(spark, tmp_path):
    """One mark and one header however many parts there are, rows in order, no part without rows but the header's."""
    df = spark.range(1000).repartition(7).select("id", F.concat(F.lit("é\n"), F.col("id")).alias("name"))
    report.write_csv(df, str(tmp_path / "out"), ["id", "name"], ["id"])
    text = exported(tmp_path / "out")
    assert text == '\ufeff"id","name"\r\n' + "".join(f'"{i}","é\n{i}"\r\n' for i in range(1000))
    assert all(p.stat().st_size for p in (tmp_path / "out").glob("part-*"))
    report.write_csv(df.limit(0), str(tmp_path / "none"), ["id"], ["id"])
    assert exported(tmp_path / "none") == '\ufeff"id"\r\n'


def test_nested_report_and_export(spark, teams, tx):
    f = ledger.team_finance(teams, ledger.active_sales(tx))
    squads = spark.createDataFrame([("t2", "p3", "C", "Batter", 600), ("t2", "p1", "A", "Batter", 450)], "team_id string, player_id string, player_name string, role string, price long")
    rows = {r["team_id"]: r["squad"] for r in report.nested_report(f, squads).collect()}
    assert [x["player_id"] for x in rows["t2"]] == ["p1", "p3"] and rows["t3"] is None
    assert "pin" not in report.export_state(teams.withColumn("pin", F.lit("1")), ["pin"]).first()["json"]


def test_latest_version(spark):
    rows = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("m", 2, "x")], "key string, version long, v string")
    assert {(r["key"], r["v"]) for r in ledger.latest_version(rows, "key", "version").collect()} == {("k", "c"), ("m", "x")}
