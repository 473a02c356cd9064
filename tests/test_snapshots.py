import json

import pytest

from ledgerloom.sources import snapshots as S


def state(version=1, **change):
    s = {
        "schemaVersion": 1, "version": version, "updatedAt": "2024-01-01T00:00:00.000Z",
        "auction": {"name": "Cup", "status": "live", "result": "waiting", "currency": "INR", "currencySymbol": "₹", "revealNextPlayer": False, "allowOverride": True, "startingPurse": 1000, "defaultBidIncrement": 50, "minSquadSize": 1, "maxSquadSize": None, "sequence": 3, "currentPlayerId": None, "highestBidTeamId": None, "highestBid": None, "showOtherPurses": False, "requireTeamPin": False, "allowUnsoldReintroduction": True, "bidIncrements": [{"upTo": 100, "increment": 5}, {"upTo": None, "increment": 10}], "roleRequirements": {"batter": {"min": 0, "max": None}}},
        "teams": [{"id": "t1", "name": "Reds", "owner": "", "logo": "", "initialPurse": 1000, "active": True, "pinHash": "h1"}, {"id": "t2", "name": "Blues", "owner": "", "logo": "", "initialPurse": 1000, "active": True, "pinHash": None}],
        "players": [{"id": "p1", "name": "A", "role": "Batter", "category": "", "basePrice": 1, "status": "sold", "teamId": "t1", "salePrice": 400, "sequence": 3}, {"id": "p2", "name": "B", "role": "Bowler", "category": "", "basePrice": 1, "status": "available", "teamId": None, "salePrice": None, "sequence": None}],
        "transactions": [
            {"id": "a", "sequence": 1, "type": "sale", "timestamp": "2024-01-01T00:00:00Z", "playerId": "p1", "teamId": "t2", "price": 300, "reversed": True},
            {"id": "b", "sequence": 2, "type": "undo", "timestamp": "2024-01-01T00:00:00Z", "playerId": "p1", "teamId": "t2", "price": 300, "referenceId": "a"},
            {"id": "c", "sequence": 3, "type": "sale", "timestamp": "2024-01-01T00:00:00Z", "playerId": "p1", "teamId": "t1", "price": 400, "reversed": False},
        ],
        "audit": [{"id": "x", "timestamp": "2024-01-01T00:00:00Z", "action": "start", "actor": "admin", "details": "{}"}, {"id": "y", "timestamp": "2024-01-01T00:00:00Z", "action": "player.sold", "actor": "admin", "details": "{}"}],
    }
    for k, v in change.items():
        at = s
        *path, last = k.split("__")
        for p in path:
            at = at[int(p) if p.isdigit() else p]
        at[last] = v
    return s


def put(folder, name, s, when):
    import os

    p = folder / name
    p.write_text(s if isinstance(s, str) else json.dumps(s))
    os.utime(p, (when, when))


def test_valid(spark, tmp_path):
    put(tmp_path, "snapshot-2024-v1.json", state(), 1)
    assert S.validated(S.load(spark, str(tmp_path))).first()["problems"] == []


BROKEN = [
    ("schemaVersion", 2, "schema version"), ("updatedAt", "soon", "updatedAt"), ("teams", None, "root shape"), ("auction__status", "odd", "status"), ("auction__maxSquadSize", 0, "settings"), ("auction__bidIncrements__0__upTo", None, "tiers"),
    ("auction__roleRequirements__batter__max", -1, "role rules"), ("teams__1__name", " reds", "team names"), ("teams__1__id", "t1", "team ids"), ("players__1__status", "sold", "sold state"), ("players__0__teamId", "t9", "player team"), 
    ("auction__highestBidTeamId", "t1", "bid"), ("transactions__1__sequence", 1, "transaction ids"), ("transactions__1__referenceId", "c", "undo reference"), ("transactions__0__reversed", False, "one sale a player"), ("players__0__salePrice", 401, "sale matches player"), ("transactions__2__reversed", True, "player has sale"),
    ("auction__result", "sold", "result state"), ("auction__result", "live", "result state"), ("auction__currencySymbol", "", "currency symbol"), ("auction__allowOverride", None, "switches"), ("auction__currentPlayerId", "p9", "current player"),
    ("auction__sequence", 2, "sequence"), ("teams__0__initialPurse", 399, "overspent"),
]


def test_each_break_is_found(spark, tmp_path):
    for i, (key, value, _) in enumerate(BROKEN):
        put(tmp_path, f"snapshot-{i}-v1.json", state(**{key: value}), i)
    put(tmp_path, "snapshot-99-v1.json", '{"schemaVersion": 1, "vers', 99)
    got = {r["file_name"]: r["problems"] for r in S.validated(S.load(spark, str(tmp_path))).collect()}
    for i, (_, _, name) in enumerate(BROKEN):
        assert name in got[f"snapshot-{i}-v1.json"], (name, got[f"snapshot-{i}-v1.json"])
    assert "unreadable" in got["snapshot-99-v1.json"]


def test_recovery_takes_the_newest_valid_one(spark, tmp_path):
    put(tmp_path, "snapshot-1-v1.json", state(1), 100)
    put(tmp_path, "snapshot-2-v2.json", state(2), 200)
    put(tmp_path, "snapshot-3-v3.json", state(3, auction__status="odd"), 300)
    put(tmp_path, "snapshot-4-v4.json", "{", 400)
    put(tmp_path, "notes.json", state(9), 500)
    snaps = S.load(spark, str(tmp_path / "snapshot-*.json"))
    assert S.recover(snaps).first()["version"] == 2
    assert S.recover(snaps.where("version = 3")).collect() == []
    names = [r["file_name"] for r in S.listing(spark, str(tmp_path)).collect()]
    assert names == [f"snapshot-{i}-v{i}.json" for i in (4, 3, 2, 1)]
    assert [r["file_name"] for r in S.expired(S.listing(spark, str(tmp_path)), 3).collect()] == ["snapshot-1-v1.json"]
    assert tuple(S.summary(snaps.where("version = 2")).first())[1:] == ("Cup", "live", 2, 2, 1)
    assert [r["action"] for r in S.audit_feed(snaps.where("version = 2")).collect()] == ["player.sold", "start"]
    assert S.audit_feed(snaps.where("version = 2"), 1).count() == 1
    assert S.ledger_tables(snaps.where("version = 2"))["transactions"].count() == 3


def test_restore_keeps_credentials(spark, tmp_path):
    put(tmp_path, "snapshot-1-v7.json", state(7), 100)
    put(tmp_path, "snapshot-2-v1.json", state(1, teams__0__pinHash=None, teams__1__pinHash="theirs"), 200)
    put(tmp_path, "snapshot-3-v1.json", state(1, updatedAt="never"), 300)
    snaps = S.load(spark, str(tmp_path))
    now, own, bad = (snaps.where(f"file_name = 'snapshot-{i}-v{v}.json'") for i, v in ((1, 7), (2, 1), (3, 1)))
    out = S.restore(own, now).first()
    assert out["version"] == 8 and [t["pinHash"] for t in out["teams"]] == ["h1", None]
    assert S.restore(bad, now).collect() == []
    assert "pinHash" not in S.public(now).first()["json"]


def test_commit_guards_the_version(spark, tmp_path):
    put(tmp_path, "snapshot-1-v1.json", state(1), 100)
    folder = str(tmp_path)
    cur = S.load(spark, folder + "/snapshot-1-v1.json")
    assert S.commit(cur, folder, 1, "20240102") == 2
    assert S.recover(S.load(spark, folder)).first()["version"] == 2
    with pytest.raises(RuntimeError):
        S.commit(cur, folder, 1, "20240103")
    import pyspark.sql.functions as F

    with pytest.raises(ValueError, match="updatedAt"):
        S.commit(cur.withColumn("updatedAt", F.lit("x")), folder, 2, "20240104")
    assert sorted(p.name for p in tmp_path.glob("*.json")) == ["snapshot-1-v1.json", "snapshot-20240102-v2.json"]


def test_a_finished_player_stays_current(spark, tmp_path):
    put(tmp_path, "snapshot-1-v1.json", state(auction__currentPlayerId="p1", auction__result="sold"), 1)
    assert S.validated(S.load(spark, str(tmp_path))).first()["problems"] == []


def test_two_writers_with_different_stamps(spark, tmp_path):
    """The first one to claim a version writes it; the other raises, whatever its stamp, until a dead writer's claim is taken back."""
    put(tmp_path, "snapshot-1-v1.json", state(1), 100)
    cur = S.load(spark, f"{tmp_path}/snapshot-1-v1.json")
    (tmp_path / "_claim-v2").touch()
    with pytest.raises(RuntimeError, match="claimed"):
        S.commit(cur, str(tmp_path), 1, "20240102")
    assert [p.name for p in tmp_path.glob("*.json")] == ["snapshot-1-v1.json"]
    S.release_claim(spark, str(tmp_path), 2)
    assert S.commit(cur, str(tmp_path), 1, "20240103") == 2


def test_prune_keeps_the_newest(spark, tmp_path):
    for i in range(1, 6):
        put(tmp_path, f"snapshot-{i}-v{i}.json", state(i), 100 * i)
    assert sorted(S.prune(spark, str(tmp_path), 2)) == [f"snapshot-{i}-v{i}.json" for i in (1, 2, 3)]
    assert sorted(p.name for p in tmp_path.glob("*.json")) == ["snapshot-4-v4.json", "snapshot-5-v5.json"]
