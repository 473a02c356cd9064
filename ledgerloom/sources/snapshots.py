"""Versioned state snapshots as JSON documents: load, validate, list, recover, restore, commit, retain.

A snapshot is one JSON file, ``snapshot-<stamp>-v<version>.json``; a folder of them is one DataFrame with a row for each file, so validation of all
of them is one job and the newest valid one is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME = r"snapshot-[0-9TZ-]+-v\d+\.json"
SCHEMA_VERSION, KEEP, HISTORY_CAP = 1, 40, 10_000

SCHEMA = """
schemaVersion int, version long, updatedAt string,
auction struct<name:string, status:string, result:string, currency:string, startingPurse:long, defaultBidIncrement:long, minSquadSize:int, maxSquadSize:int, sequence:long,
  currentPlayerId:string, highestBidTeamId:string, highestBid:long, currencySymbol:string, showOtherPurses:boolean, revealNextPlayer:boolean, allowOverride:boolean, requireTeamPin:boolean, allowUnsoldReintroduction:boolean,
  bidIncrements:array<struct<upTo:long,increment:long>>, roleRequirements:map<string,struct<min:int,max:int>>>,
teams array<struct<id:string,name:string,owner:string,logo:string,initialPurse:long,active:boolean,pinHash:string>>,
players array<struct<id:string,name:string,role:string,category:string,basePrice:long,status:string,teamId:string,salePrice:long,sequence:long>>,
transactions array<struct<id:string,sequence:long,type:string,timestamp:string,playerId:string,teamId:string,price:long,reversed:boolean,referenceId:string>>,
audit array<struct<id:string,timestamp:string,action:string,actor:string,details:string>>,
_corrupt string
"""


def load(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each file, unreadable ones too (in ``_corrupt``), with file name and modification time."""
    df = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot files, newest first, without reading their content."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    files = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return files.where(F.col("file_name").rlike(f"^{NAME}$")).drop("path").orderBy(F.desc("modified"), F.desc("file_name"))


def _has_duplicates(items: Column) -> Column:
    return F.size(items) > F.size(F.array_distinct(items))


def problems() -> Column:
    """Array of what is wrong with a state; empty if it is valid."""
    a, teams, players, tx = F.col("auction"), F.col("teams"), F.col("players"), F.col("transactions")
    lower = lambda col, field: F.transform(col, lambda x: F.lower(F.trim(x[field])))
    none = lambda c: F.coalesce(c, F.lit(False))
    known_team = lambda x: F.exists(teams, lambda t: t["id"] == x)
    known_player = lambda x: F.exists(players, lambda p: p["id"] == x)
    current = F.filter(players, lambda p: p["status"] == "current")
    sales = F.filter(tx, lambda t: (t["type"] == "sale") & ~none(t["reversed"]))
    spent = lambda t: F.aggregate(F.filter(players, lambda p: none(p["teamId"] == t["id"])), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p["salePrice"], F.lit(0).cast("long")))
    tiers = F.coalesce(a["bidIncrements"], F.array().cast("array<struct<upTo:bigint,increment:bigint>>"))
    before = lambda i: F.get(tiers, i - 1)["upTo"]
    checks: list[tuple[str, Column]] = [
        ("unreadable", F.col("_corrupt").isNotNull()),
        ("schema version", F.coalesce(F.col("schemaVersion") != SCHEMA_VERSION, F.lit(True))),
        ("version", F.coalesce(F.col("version") < 0, F.lit(True))),
        ("updatedAt", F.try_to_timestamp("updatedAt").isNull()),
        ("root shape", a.isNull() | teams.isNull() | players.isNull() | tx.isNull() | F.col("audit").isNull()),
        ("history cap", none((F.size(tx) > HISTORY_CAP) | (F.size("audit") > HISTORY_CAP))),
        ("status", ~none(a["status"].isin("not-started", "live", "paused", "completed"))),
        ("result", ~none(a["result"].isin("waiting", "live", "sold", "unsold"))),
        ("settings", ~none((a["startingPurse"] > 0) & (a["defaultBidIncrement"] > 0) & (a["minSquadSize"] >= 0)) | none(a["maxSquadSize"] < a["minSquadSize"])),
        ("tiers", none(F.exists(F.transform(tiers, lambda t, i: none(t["increment"] < 1) | ((i > 0) & (before(i).isNull() | none(t["upTo"] <= before(i))))), lambda bad: bad))),
        ("switches", F.array(*[a[c] for c in ("showOtherPurses", "revealNextPlayer", "allowUnsoldReintroduction", "allowOverride", "requireTeamPin")]).isNull() | F.exists(F.array(*[a[c] for c in ("showOtherPurses", "revealNextPlayer", "allowUnsoldReintroduction", "allowOverride", "requireTeamPin")]), lambda x: x.isNull())),
        ("currency symbol", ~none(F.length(a["currencySymbol"]).between(1, 6))),
        ("result state", none(a["result"].isin("live", "sold", "unsold") & ~none(F.exists(players, lambda p: (p["id"] == a["currentPlayerId"]) & (p["status"] == F.when(a["result"] == "live", "current").otherwise(a["result"])))))),
        ("role rules", none(F.exists(F.map_values(a["roleRequirements"]), lambda r: r["max"] < r["min"]))),
        ("team ids", none(_has_duplicates(F.transform(teams, lambda t: t["id"])))),
        ("team names", none(_has_duplicates(lower(teams, "name")))),
        ("team shape", none(F.exists(teams, lambda t: ~none(t["initialPurse"] > 0) | ~none(F.length(F.trim(t["name"])) > 0)))),
        ("player ids", none(_has_duplicates(F.transform(players, lambda p: p["id"])))),
        ("player status", none(F.exists(players, lambda p: ~none(p["status"].isin("available", "current", "sold", "unsold"))))),
        ("sold state", none(F.exists(players, lambda p: none(p["status"] == "sold") != (p["teamId"].isNotNull() & p["salePrice"].isNotNull() & p["sequence"].isNotNull())))),
        ("player team", none(F.exists(players, lambda p: p["teamId"].isNotNull() & ~none(known_team(p["teamId"]))))),
        ("current player", none(F.size(current) > 1) | none(F.get(current, F.lit(0))["id"] != a["currentPlayerId"]) | none(a["currentPlayerId"].isNotNull() & ~none(known_player(a["currentPlayerId"])))),
        ("bid", none(a["highestBidTeamId"].isNotNull() & a["highestBid"].isNull()) | none(a["highestBid"].isNotNull() & a["currentPlayerId"].isNull())),
        ("bid team", none(a["highestBidTeamId"].isNotNull() & ~none(known_team(a["highestBidTeamId"])))),
        ("transaction ids", none(_has_duplicates(F.transform(tx, lambda t: t["id"])) | _has_duplicates(F.transform(tx, lambda t: t["sequence"])))),
        ("transaction shape", none(F.exists(tx, lambda t: ~none(t["type"].isin("sale", "unsold", "undo")) | ~none(t["sequence"] > 0) | ~none(known_player(t["playerId"])) | F.try_to_timestamp(t["timestamp"]).isNull()))),
        ("undo reference", none(F.exists(F.transform(tx, lambda t, i: none(t["type"] == "undo") & ~none(F.exists(F.slice(tx, F.lit(1), i), lambda o: o["id"] == t["referenceId"]))), lambda bad: bad))),
        ("one sale a player", none(_has_duplicates(F.transform(sales, lambda t: t["playerId"])))),
        ("sale matches player", none(F.exists(sales, lambda t: ~none(F.exists(players, lambda p: none((p["id"] == t["playerId"]) & (p["status"] == "sold") & (p["teamId"] == t["teamId"]) & (p["salePrice"] == t["price"]) & (p["sequence"] == t["sequence"]))))))),
        ("player has sale", none(F.exists(players, lambda p: none(p["status"] == "sold") & ~none(F.exists(sales, lambda t: t["playerId"] == p["id"]))))),
        ("sequence", none(a["sequence"] < F.coalesce(F.array_max(F.transform(tx, lambda t: t["sequence"])), F.lit(0)))),
        ("overspent", none(F.exists(teams, lambda t: t["initialPurse"] - spent(t) < 0))),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())


def validated(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("problems", problems())


def recover(snapshots: DataFrame) -> DataFrame:
    """The newest valid snapshot, or no row. A missing main file and a corrupt one are the same case: look at all snapshots."""
    good = validated(snapshots).where(F.size("problems") == 0)
    cols = [c for c in good.columns if c != "problems"]
    best = good.agg(F.max_by(F.struct(*cols), F.struct("modified", "file_name")).alias("s"))
    return best.where(F.col("s").isNotNull()).select("s.*")


def summary(snapshots: DataFrame) -> DataFrame:
    sales = F.filter("transactions", lambda t: (t["type"] == "sale") & ~F.coalesce(t["reversed"], F.lit(False)))
    return snapshots.select("file_name", F.col("auction.name").alias("name"), F.col("auction.status").alias("status"), F.size("teams").alias("teams"), F.size("players").alias("players"), F.size(sales).alias("active_sales"))


def restore(candidate: DataFrame, current: DataFrame) -> DataFrame:
    """A candidate state in place of the current one: credentials come from the current teams by id, the version is the current one's successor. Only valid
    candidates give a row."""
    own = current.select(F.col("version").alias("_version"), F.map_from_entries(F.transform(F.filter("teams", lambda t: t["pinHash"].isNotNull()), lambda t: F.struct(t["id"], t["pinHash"]))).alias("_pins"))
    rows = validated(candidate).where(F.size("problems") == 0).drop("problems").crossJoin(F.broadcast(own))  # one row each
    teams = F.transform("teams", lambda t: t.withField("pinHash", F.try_element_at("_pins", t["id"])))
    return rows.withColumn("teams", teams).withColumn("version", F.col("_version") + 1).drop("_version", "_pins")


def public(snapshots: DataFrame) -> DataFrame:
    """Export without credentials, as JSON."""
    out = snapshots.withColumn("teams", F.transform("teams", lambda t: t.dropFields("pinHash")))
    return out.select(F.to_json(F.struct(*[c for c in out.columns if c not in ("_corrupt", "file_name", "modified")])).alias("json"))


def commit(state: DataFrame, folder: str, expected: int, stamp: str) -> int:
    """Write the next version beside the others if the folder's newest valid version is the expected one. A writer first claims the version with a file whose name
    depends on the version only and which can be made once, so of two writers with different stamps one raises; Spark's committer then renames whole files, so readers
    never see half a snapshot. A lost race or an invalid state leaves the folder as it was; a writer that dies leaves its claim, which ``release_claim`` takes back."""
    spark = state.sparkSession
    try:
        newest = recover(load(spark, folder)).select("version").first()
    except Exception as e:  # an empty folder has no newest version
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        newest = None
    have = newest["version"] if newest else 0
    if have != expected:
        raise RuntimeError(f"version is {have}, not {expected}")
    bad = validated(state.withColumn("_corrupt", F.lit(None).cast("string"))).select("problems").first()["problems"]
    if bad:
        raise ValueError(", ".join(bad))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs, tmp = path(folder).getFileSystem(conf), f"{folder}/_writing-{stamp}-v{expected + 1}"
    claimed = path(f"{folder}/_claim-v{expected + 1}")
    if fs.exists(claimed) or not fs.createNewFile(claimed):
        raise RuntimeError(f"version {expected + 1} is claimed by another writer")
    rows = state.withColumn("version", F.lit(expected + 1).cast("long")).select(*[c for c in state.columns if c not in ("_corrupt", "file_name", "modified")])
    rows.coalesce(1).write.mode("overwrite").json(tmp)
    part = next(f.getPath() for f in fs.listStatus(path(tmp)) if f.getPath().getName().startswith("part-"))
    if not fs.rename(part, path(f"{folder}/snapshot-{stamp}-v{expected + 1}.json")):
        raise RuntimeError("the snapshot is there already")
    fs.delete(path(tmp), True)
    return expected + 1


def release_claim(spark: SparkSession, folder: str, version: int) -> None:
    """Take back the claim of a writer that died before its snapshot was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_claim-v{version}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)


def prune(spark: SparkSession, folder: str, keep: int = KEEP) -> list[str]:
    """Delete the snapshots beyond the newest ``keep``; their names. A folder has some dozens of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [r["file_name"] for r in expired(listing(spark, folder), keep).collect()]
    for name in gone:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        at.getFileSystem(conf).delete(at, False)
    return gone


def expired(listed: DataFrame, keep: int = KEEP) -> DataFrame:
    """Files beyond the newest ``keep``."""
    rank = F.row_number().over(Window.orderBy(F.desc("modified"), F.desc("file_name")))  # a folder listing: some dozens of rows
    return listed.withColumn("rank", rank).where(F.col("rank") > keep).drop("rank")


def audit_feed(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Audit rows, newest first."""
    rows = snapshots.select(F.posexplode("audit").alias("pos", "a")).select("pos", "a.*").orderBy(F.desc("pos"))
    return rows.limit(limit) if limit else rows


def ledger_tables(snapshots: DataFrame) -> dict[str, DataFrame]:
    """teams, players and transactions as tables with their array position as ``pos``: order is data."""
    return {name: snapshots.select("version", F.posexplode(name).alias("pos", "r")).select("version", "pos", "r.*") for name in ("teams", "players", "transactions")}

