import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.streaming import stateful
from ledgerloom.streaming.fold import Settings, fold, run_commands
from ledgerloom.streaming.stateful import Limiter


def verdicts(limiter, attempts):
    state, out = (0, 0, 0), []
    for at, ok in attempts:
        state, v = limiter.step(state, at, ok)
        out.append((v, state[0]))
    return out


def test_limiter():
    f = [(i * 1000, False) for i in range(6)]
    assert [v for v, _ in verdicts(Limiter(), f)] == ["failed"] * 4 + ["blocked", "rejected"]
    again = [*f[:5], (64_001, False), (64_002, False)]  # just after the block, inside the window: blocked at once
    assert [v for v, _ in verdicts(Limiter(), again)][-2:] == ["blocked", "rejected"]
    fresh = [*f[:4], (300_001, False)]
    assert verdicts(Limiter(), fresh)[-1] == ("failed", 1)
    assert verdicts(Limiter(), [*f[:4], (5000, True), (6000, False)])[-1] == ("failed", 1)


def test_limiter_batch_equals_steps(spark):
    r = random.Random(1)
    log = []
    for k in range(6):
        t = 0
        for _ in range(80):
            t += r.choice([10, 500, 20_000, 70_000, 310_000])
            log.append((str(k), t, len(log), r.random() < 0.1))
    df = spark.createDataFrame(log, "key string, at_ms long, seq long, ok boolean")
    got = {r["seq"]: (r["verdict"], r["failures"]) for r in stateful.limit_batch(df).collect()}
    for k in range(6):
        rows = [x for x in log if x[0] == str(k)]
        for (_, _, seq, _), want in zip(rows, verdicts(Limiter(), [(a, ok) for _, a, _, ok in rows]), strict=True):
            assert got[seq] == want


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [("a", i * 1000, i == 3) for i in range(12)] + [("b", i * 7000, False) for i in range(12)]
    schema = "key string, at_ms long, ok boolean"
    for part in range(3):  # three files, three micro-batches
        spark.createDataFrame([r for i, r in enumerate(rows) if (i % 12) // 4 == part], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.json"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) >= 3
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stateful.limit_stream(src).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["key"], r["at_ms"], r["verdict"], r["failures"]) for r in spark.table("limits").collect())
    want = sorted((k, a, *v) for k in "ab" for (_, a, _), v in zip([r for r in rows if r[0] == k], verdicts(Limiter(), [(a, ok) for kk, a, ok in rows if kk == k]), strict=True))
    assert got == want


def test_sessions_end_exactly_after_their_hours(spark):
    rows = [(1, "u", "2024-01-01 00:00:00", "login"), (2, "u", "2024-01-01 11:59:59", "view"), (3, "u", "2024-01-01 12:00:00", "view"), (4, "v", "2024-01-01 00:00:00", "view")]
    log = spark.createDataFrame(rows, "event_id long, user string, at string, action string").withColumn("ts", F.to_timestamp("at"))
    got = {r["event_id"]: r["valid"] for r in stateful.session_validity(log, "user", "ts", F.col("action") == "login").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_presence(spark):
    rows = [(1, "u", "2024-01-01 00:00:00", "in"), (2, "u", "2024-01-01 00:00:02", "out"), (3, "u", "2024-01-01 00:00:03", "in")]
    log = spark.createDataFrame(rows, "event_id long, user string, at string, a string").withColumn("ts", F.to_timestamp("at"))
    got = [(r["event_id"], r["until_event"], r["micros"]) for r in stateful.presence(log, "user", "ts", F.col("a") == "in", F.col("a") == "out").orderBy("event_id").collect()]
    assert got == [(1, 2, 2_000_000), (3, None, None)]


def test_change_feed_keeps_the_newest_version(spark, tmp_path):
    spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 1, "x")], "key string, version long, v string").coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    q = stateful.change_feed(spark.readStream.schema("key string, version long, v string").json(str(tmp_path / "in")), lambda df, i: seen.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen) == [("k", 2, "b"), ("m", 1, "x")]


SETUP = [(1, "team.add", None, "t1", 1000, False), (2, "team.add", None, "t2", 1000, False), (3, "player.add", "p1", None, 100, False), (4, "player.add", "p2", None, 100, False), (5, "start", None, None, None, False)]


def play(*more, settings=None):
    return run_commands([*SETUP, *[(10 + i, *m) for i, m in enumerate(more)]], settings or Settings())


@pytest.mark.parametrize(
    ("commands", "accepted"),
    [
        ([("player.select", "p1", None, None, False), ("bid", None, "t1", 125, False), ("bid", None, "t1", 125, True), ("sell", None, None, None, False)], [True, False, True, True]),
        ([("bid", None, "t1", 100, False)], [False]),
        ([("player.select", "p1", None, None, False), ("bid", None, "t1", 100, False), ("bid", None, "t2", 100, False), ("bid", None, "t2", 150, False), ("unsold", None, None, None, False)], [True, True, False, True, False]),
        ([("player.select", "p1", None, None, False), ("unsold", None, None, None, False), ("player.select", "p1", None, None, False)], [True, True, True]),
        ([("player.select", "p1", None, None, False), ("bid", None, "t1", 50, True), ("sell", None, None, None, True)], [True, True, False]),
        ([("pause", None, None, None, False), ("player.select", "p1", None, None, False), ("resume", None, None, None, False), ("end", None, None, None, False), ("end", None, None, None, False)], [True, False, True, True, False]),
        ([("player.select", "p1", None, None, False), ("bid", None, "t1", 1050, True)], [True, False]),
        ([("undo", None, None, None, False)], [False]),
    ],
)
def test_guards(commands, accepted):
    assert [r[2] for r in play(*commands)[5:]] == accepted


def test_undo_restores_the_bid_and_the_purse():
    rows = play(("player.select", "p1", None, None, False), ("bid", None, "t1", 100, False), ("sell", None, None, None, False), ("player.select", "p2", None, None, False), ("undo", None, None, None, False), ("sell", None, None, None, False))
    assert [r[2] for r in rows[5:]] == [True] * 6
    assert [r[8] for r in rows[-3:]][1:] == [1000, 900] and [r[4] for r in rows if r[4]] == [1, 2, 3]


def test_squad_limit():
    s = Settings(max_squad=1)
    one = [("player.select", "p1", None, None, False), ("bid", None, "t1", 100, False), ("sell", None, None, None, False)]
    rows = play(*one, ("player.select", "p2", None, None, False), ("bid", None, "t1", 100, False), settings=s)
    assert rows[-1][2:4] == (False, "squad is full")


def test_role_limit_and_reset():
    s = Settings(roles={"p1": "Batter", "p2": "Batter"}, role_max={"Batter": 1})
    one = [("player.select", "p1", None, None, False), ("bid", None, "t1", 100, False), ("sell", None, None, None, False)]
    rows = play(*one, ("player.select", "p2", None, None, False), ("bid", None, "t1", 100, False), ("bid", None, "t2", 100, False), ("reset", None, None, None, False), ("start", None, None, None, False), *one, settings=s)
    assert [r[2] for r in rows[5:]] == [True] * 4 + [False] + [True] * 6
    assert rows[9][3] == "role is full" and (rows[-1][4], rows[-1][8]) == (1, 900)


def test_setup_commands_before_the_start_only():
    setup = [(1, "team.add", None, "t1", 1000, False), (2, "team.update", None, "t1", 300, False), (3, "team.update", None, "t9", 300, False), (4, "team.add", None, "t2", 5, False), (5, "team.remove", None, "t2", None, False), (6, "player.add", "p1", None, 100, False), (7, "player.update", "p1", None, 200, False), (8, "player.add", "p2", None, 1, False), (9, "player.remove", "p2", None, None, False), (10, "start", None, None, None, False), (11, "team.remove", None, "t1", None, False), (12, "player.select", "p1", None, None, False), (13, "bid", None, "t1", 100, False), (14, "bid", None, "t1", 200, False), (15, "team.add", None, "t1", 1, False)]
    assert [r[2] for r in run_commands(setup, Settings())] == [True, True, False, True, True, True, True, True, True, True, False, True, False, True, False]


COMMAND = st.tuples(st.sampled_from(["player.select", "bid", "sell", "unsold", "undo", "pause", "resume"]), st.sampled_from(["p1", "p2"]), st.sampled_from(["t1", "t2", None]), st.sampled_from([None, 100, 150, 200, 400, 900]), st.booleans())


@settings(max_examples=150, deadline=None)
@given(st.lists(COMMAND, max_size=40))
def test_invariants_hold_under_any_commands(commands):
    rows = play(*commands)
    spent, owner, last = {"t1": 0, "t2": 0}, {}, None
    for _, command, ok, _, tx, player, team, price, remaining in rows[5:]:
        if not ok:
            continue
        if command == "sell":
            assert player not in owner
            owner[player] = team
            spent[team] += price
        elif command == "undo":
            assert last == "sell"
            spent[owner.pop(player)] -= price
        if command in ("sell", "undo"):
            assert remaining == 1000 - spent[team] >= 0
        last = command if tx else last
    seqs = [r[4] for r in rows if r[4]]
    assert seqs == list(range(1, len(seqs) + 1))


def test_fold_runs_each_event_alone(spark):
    log = [(e, *r) for e in (1, 2) for r in [*SETUP, (10, "player.select", "p1", None, None, False), (11, "bid", None, "t1", 100, False), (12, "sell", None, None, None, False)]]
    r = random.Random(2)
    r.shuffle(log)
    df = spark.createDataFrame(log, "event_id long, seq long, command string, player_id string, team_id string, amount long, override boolean")
    out = fold(df).where("command = 'sell'").collect()
    assert sorted((x["event_id"], x["accepted"], x["price"], x["remaining"]) for x in out) == [(1, True, 100, 900), (2, True, 100, 900)]


def test_undo_after_an_override_sale():
    """An override changes team and price of a sale, but needs a bid; undo brings the bid back, and the sale can be confirmed again."""
    no_bid = play(("player.select", "p1", None, None, False), ("sell", None, "t2", 500, True))
    assert no_bid[-1][2:4] == (False, "no bid")
    rows = play(("player.select", "p1", None, None, False), ("bid", None, "t1", 100, False), ("sell", None, "t2", 500, True), ("undo", None, None, None, False), ("sell", None, None, None, False))
    assert [r[2] for r in rows[5:]] == [True] * 5
    assert rows[-3][6:] == ("t2", 500, 500) and rows[-2][6:] == ("t2", 500, 1000) and rows[-1][6:] == ("t1", 100, 900)


def test_undo_puts_a_selected_player_back_to_its_latest_result():
    one = [("player.select", "p1", None, None, False), ("unsold", None, None, None, False), ("player.select", "p2", None, None, False), ("bid", None, "t1", 100, False), ("sell", None, None, None, False)]
    again = [("player.select", "p1", None, None, False), ("undo", None, None, None, False), ("undo", None, None, None, False)]
    off = Settings(reintroduce=False)
    rows = play(*one, ("undo", None, None, None, False), ("sell", None, None, None, False), settings=off)
    assert [r[2] for r in rows[5:]] == [True] * 7
    rows = play(*one, *again)
    assert [r[2] for r in rows[-3:]] == [True, True, False]
    # p1 was unsold before it was selected, so it is unsold again and, without reintroduction, not eligible
    state = [("player.select", "p1", None, None, False)]
    rows = play(*one, *again[:2], ("sell", None, None, None, False), *state)
    assert rows[-1][2]


def test_setup_commands_with_details():
    rows = [
        (1, "team.add", None, "t1", None, False, {"name": "Reds", "active": False}),
        (2, "team.add", None, "t2", None, False, {"name": " reds "}),
        (3, "start", None, None, None, False),
        (4, "player.import", None, None, None, False, {"rows": [{"id": "p1", "role": "batsman", "basePrice": 70}, {"id": "p2", "role": "Umpire"}]}),
        (5, "player.import", None, None, None, False, {"rows": [{"id": "p1", "role": "batsman", "basePrice": 70}, {"id": "p2", "role": "keeper"}]}),
        (6, "player.import", None, None, None, False, {"rows": [{"id": "p3"}, {"id": "p1"}]}),
        (7, "player.update", "p2", None, None, False, {"id": "p1"}),
        (8, "player.update", "p2", None, None, False, {"id": "p9", "role": "Batter"}),
        (9, "start", None, None, None, False),
        (10, "team.import", None, None, None, False, {"rows": [{"id": "t5", "name": "Blues"}, {"id": "t6", "name": "blues"}]}),
        (11, "team.import", None, None, None, False, {"rows": [{"id": "t5", "name": "Blues", "initialPurse": 300}]}),
        (12, "settings.update", None, None, None, False, {"tiers": [[None, 5], [100, 5]]}),
        (13, "settings.update", None, None, None, False, {"show_others": False}),
        (14, "settings.update", None, None, None, False, {"min_squad": 4, "max_squad": 3}),
        (15, "settings.update", None, None, None, False, {"step": 10, "role_max": {"Batter": 1}, "tiers": [[100, 10], [None, 25]]}),
        (16, "team.update", None, "t1", None, False, {"name": "BLUES"}),
        (17, "start", None, None, None, False),
        (18, "settings.update", None, None, None, False, {"step": 1}),
        (19, "player.select", "p1", None, None, False),
        (20, "bid", None, "t1", 70, False),
        (21, "bid", None, "t5", 70, False),
        (22, "sell", None, None, None, False),
        (23, "player.select", "p9", None, None, False),
        (24, "bid", None, "t5", 100, False),
    ]
    out = run_commands(iter(rows), Settings())
    assert [r[2] for r in out] == [True, False, False, False, True, False, False, True, False, False, True, False, False, False, True, False, True, False, True, False, True, True, True, False]
    why = {r[0]: r[3] for r in out if not r[2]}
    assert why[2] == "team name exists" and why[3] == why[9] == "needs an active team and a player" and why[4] == "unknown role" and why[6] == why[7] == "player exists"
    assert why[10] == why[16] == "team name exists" and why[12] == "an open tier must be the last" and why[13] == "needs a pin" and why[14] == "least squad size above the most"
    assert why[18] == "already started" and why[20] == "no such team" and why[24] == "role is full"


def test_limiter_cuts_bursts(spark):
    """A pause longer than the window and the block starts afresh: verdicts are those of the steps, over many bursts of one key."""
    r = random.Random(5)
    t, log = 0, []
    for i in range(600):
        t += r.choice([100, 1000, 290_000, 300_000, 300_001, 900_000])
        log.append(("k", t, i, r.random() < 0.05))
    df = spark.createDataFrame(log, "key string, at_ms long, seq long, ok boolean")
    got = {x["seq"]: (x["verdict"], x["failures"]) for x in stateful.limit_batch(df).collect()}
    assert [got[i] for i in range(600)] == verdicts(Limiter(), [(a, ok) for _, a, _, ok in log])


def test_masked_feed_and_replay(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "key string, team_id long, spent long")
    viewers = spark.createDataFrame([(1, "a", "admin", None), (2, "a", "team", 2), (3, "a", "display", None), (4, "b", "team", 2)], "viewer_id int, key string, role string, viewer_team long")
    got = sorted((x["viewer_id"], x["team_id"], x["spent"]) for x in stateful.masked_for(rows, viewers, ("spent",)).collect() if x["spent"] is not None)
    assert got == [(1, 1, 10), (1, 2, 20), (2, 2, 20)] and stateful.masked_for(rows, viewers, ("spent",)).count() == 7
    snaps = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "key string, version long, v string")
    readers = spark.createDataFrame([("p", "a", None), ("q", "a", 3), ("r", "a", 4), ("s", "c", 1)], "reader_id string, key string, seen long")
    assert {(x["reader_id"], x["v"]) for x in stateful.replay(snaps, readers).collect()} == {("p", "z"), ("q", "z")}


def test_fold_streams_over_batches(spark):
    """Events split over Arrow batches go on with the state they had."""
    log = [(e, *r) for e in range(30) for r in [*SETUP, *[(10 + 2 * i + j, c, "p1" if c == "player.select" else None, None, None, False) for i in range(20) for j, c in enumerate(("player.select", "unsold"))]]]
    random.Random(3).shuffle(log)
    df = spark.createDataFrame(log, "event_id long, seq long, command string, player_id string, team_id string, amount long, override boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        out = fold(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(log) and all(x["accepted"] for x in out)
    assert sorted(x["tx_sequence"] for x in out if x["event_id"] == 7 and x["tx_sequence"]) == list(range(1, 21))
