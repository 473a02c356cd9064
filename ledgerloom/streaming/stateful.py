"""Keyed rules over time: rate limiter, sessions, presence, change feed. Each has a batch form; streams share the same step functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPTS = "key string, at_ms long, ok boolean"
VERDICTS = "key string, at_ms long, ok boolean, verdict string, failures int"


class Limiter:
    """Failed attempts in a window that starts with the first; ``limit`` of them block for a while. Attempts while blocked aren't
    counted. The count stays when a block ends, so the next failure inside the window blocks at once; a success forgets the key."""

    def __init__(self, limit: int = 5, window_ms: int = 300_000, block_ms: int = 60_000):
        self.limit, self.window_ms, self.block_ms = limit, window_ms, block_ms

    def step(self, state: tuple[int, int, int], at: int, ok: bool) -> tuple[tuple[int, int, int], str]:
        """state: (failures, start, blocked until), (0, 0, 0) if there is none."""
        n, start, until = state
        if until > at:
            return state, "rejected"
        if ok:
            return (0, 0, 0), "ok"
        if n == 0 or at - start > self.window_ms:
            n, start, until = 0, at, 0
        n += 1
        if n >= self.limit:
            return (n, start, at + self.block_ms), "blocked"
        return (n, start, until), "failed"


def limit_batch(attempts: DataFrame, limiter: Limiter | None = None) -> DataFrame:
    """Verdicts over a whole log. A key's attempts are cut where a pause outlasts both the window and a block: nothing before it counts any more, so each
    burst is folded by array functions on its own, inside the JVM, and a busy key is many bursts."""
    z = limiter or Limiter()
    by = Window.partitionBy("key").orderBy("at_ms", "seq")
    pause = F.col("at_ms") - F.lag("at_ms").over(by) > max(z.window_ms, z.block_ms)
    bursts = attempts.withColumn("_new", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("_burst", F.sum("_new").over(by))
    listed = bursts.groupBy("key", "_burst").agg(F.sort_array(F.collect_list(F.struct("at_ms", "seq", "ok"))).alias("rows"))
    zero = F.lit(0).cast("long")
    kind = "array<struct<seq:bigint,verdict:string,failures:bigint>>"
    start = F.struct(zero.alias("n"), zero.alias("start"), zero.alias("until"), F.array().cast(kind).alias("out"))

    def step(a: Column, r: Column) -> Column:
        rejected = a["until"] > r["at_ms"]
        fresh = (a["n"] == 0) | (r["at_ms"] - a["start"] > z.window_ms)
        n = F.when(fresh, F.lit(1).cast("long")).otherwise(a["n"] + 1)
        at = F.when(fresh, r["at_ms"]).otherwise(a["start"])
        blocks = n >= z.limit
        until = F.when(blocks, r["at_ms"] + z.block_ms).when(fresh, zero).otherwise(a["until"])
        verdict = F.when(rejected, "rejected").when(r["ok"], "ok").when(blocks, "blocked").otherwise("failed")
        keep = lambda old, new: F.when(rejected, old).when(r["ok"], zero).otherwise(new)
        m = keep(a["n"], n)
        return F.struct(
            m.alias("n"), keep(a["start"], at).alias("start"), keep(a["until"], until).alias("until"), F.concat(a["out"], F.array(F.struct(r["seq"].alias("seq"), verdict.alias("verdict"), m.alias("failures")))).alias("out")
        )

    out = listed.select("key", F.explode(F.aggregate("rows", start, step)["out"]).alias("v"))
    return out.select("key", F.col("v.seq").alias("seq"), F.col("v.verdict").alias("verdict"), F.col("v.failures").alias("failures"))


def limit_stream(attempts: DataFrame, limiter: Limiter | None = None) -> DataFrame:
    """The same over a stream of (key, at_ms, ok), with one small state a key that times out after the window and a block."""
    z = limiter or Limiter()

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cur = tuple(state.get) if state.exists else (0, 0, 0)
        for pdf in pdfs:
            out = []
            for r in pdf.sort_values("at_ms").itertuples():
                cur, verdict = z.step(cur, int(r.at_ms), bool(r.ok))
                out.append((key[0], int(r.at_ms), bool(r.ok), verdict, cur[0]))
            yield pd.DataFrame(out, columns=["key", "at_ms", "ok", "verdict", "failures"])
        state.update(cur)
        state.setTimeoutDuration(z.window_ms + z.block_ms)

    return attempts.groupBy("key").applyInPandasWithState(run, VERDICTS, "failures long, start long, until long", "append", "ProcessingTimeTimeout")


def session_validity(log: DataFrame, key: str, ts: str, login: Column, hours: int = 12) -> DataFrame:
    """The last login at or before each action; a session is valid for ``hours`` from then, not sliding, and not at the very end."""
    upto = Window.partitionBy(key).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(login, F.col(ts))).over(upto)
    rows = log.withColumn("_login", last)
    valid = F.coalesce(F.col(ts) < F.col("_login") + F.expr(f"interval {hours} hours"), F.lit(False))
    return rows.select("event_id", key, valid.alias("valid"))


def presence(log: DataFrame, key: str, ts: str, opens: Column, closes: Column) -> DataFrame:
    """Each connection with the next connect or disconnect of its key; an open one has no end."""
    moves = log.where(opens | closes).withColumn("_open", opens)
    by = Window.partitionBy(key).orderBy(ts, "event_id")
    rows = moves.withColumns({"until_event": F.lead("event_id").over(by), "_next": F.lead(ts).over(by)})
    secs = (F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))).cast("long")
    return rows.where("_open").select("event_id", key, "until_event", secs.alias("micros"))


def newest(batch: DataFrame) -> DataFrame:
    """The newest snapshot of every key."""
    cols = [c for c in batch.columns if c != "key"]
    best = batch.groupBy("key").agg(F.max_by(F.struct(*cols), F.col("version")).alias("s"))
    return best.select("key", *[F.col(f"s.{c}").alias(c) for c in cols])


def change_feed(commits: DataFrame, sink, checkpoint: str, trigger: dict | None = None):
    """Push each micro-batch's newest snapshot of every key to ``sink(batch, id)``; older versions in it are dropped. A reader that comes back goes on from the
    checkpoint; ``replay`` gives it what it missed."""

    def push(batch: DataFrame, batch_id: int) -> None:
        sink(newest(batch), batch_id)

    return commits.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def masked_for(rows: DataFrame, viewers: DataFrame, money: tuple[str, ...], show_others: bool = False) -> DataFrame:
    """(viewer_id, rows): what each viewer of a key is sent. Viewers: viewer_id, key, role, viewer_team; money columns read null for teams that a viewer may not
    look into."""
    sees = F.lit(show_others) | (F.col("role") == "admin") | F.coalesce((F.col("role") == "team") & (F.col("viewer_team") == F.col("team_id")), F.lit(False))
    out = rows.join(viewers, "key")
    return out.select("viewer_id", *[F.when(sees, F.col(c)).alias(c) if c in money else F.col(c) for c in rows.columns])


def replay(snapshots: DataFrame, readers: DataFrame) -> DataFrame:
    """What a reader that connects again is sent: the newest snapshot of its key unless it has seen a later one. Readers: reader_id, key, seen."""
    return newest(snapshots).join(readers, "key").where("seen is null or version >= seen").drop("seen")


def active_sessions(sessions: DataFrame, teams: DataFrame) -> DataFrame:
    """Sessions of teams that are still registered and active."""
    return sessions.join(teams.where("active").select(F.col("team_id").alias("_t")), F.col("team_id") == F.col("_t"), "left_semi")
