"""Reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def final_rows(squads: DataFrame, finance: DataFrame, lines: DataFrame) -> DataFrame:
    """SOLD rows with their team's money on each, then UNSOLD rows with blanks there."""
    money = finance.select("team_id", "spent", "remaining")
    sold = squads.join(money, "team_id").select(F.lit("SOLD").alias("result"), "team_id", "player_id", "price", "spent", "remaining")
    unsold = lines.where("status = 'unsold'").select(F.lit("UNSOLD").alias("result"), "player_id")
    return sold.unionByName(unsold, allowMissingColumns=True)


def nested_report(finance: DataFrame, squads: DataFrame) -> DataFrame:
    """One row for each team with its squad as a nested, ordered list; a squad's size is bounded by squad rules."""
    squad = squads.groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("player_id", "player_name", "role", "price"))).alias("squad"))
    return finance.join(squad, "team_id", "left")


def csv_cell(value: Column) -> Column:
    """Quoted cell: quotes doubled, formula starts disarmed, null as an empty cell."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): one text line for each row, made by workers; headers are for the writer."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))


HEADERS = {
    # fixed values: columns of the exports
    "players": ("id", "name", "role", "basePrice", "photo", "secondaryRole", "stats", "category", "status", "teamId", "salePrice", "sequence"),
    "teams": ("id", "name", "owner", "initialPurse", "active", "logo", "spent", "remaining", "playersPurchased"),
    "transactions": ("sequence", "type", "playerId", "playerName", "teamId", "teamName", "price", "basePrice", "reversed", "referenceId", "timestamp"),
    "report": ("teamId", "teamName", "playerName", "role", "status", "price", "sequence", "initialPurse", "spent", "remaining"),
}


def export_rows(kind: str, df: DataFrame) -> DataFrame:
    """The columns of an export by name; those that the table lacks are blank cells."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in HEADERS[kind]])


def report_rows(squads: DataFrame, finance: DataFrame, unsold: DataFrame) -> DataFrame:
    """The report's rows with their order (part, team_pos, pos): sold players under their teams with the team's money on each, then unsold players with blanks."""
    money = finance.select(F.col("team_id").alias("_t"), "initial_purse", "spent", "remaining")
    sold = squads.join(money, F.col("team_id") == F.col("_t")).select(
        F.lit(0).alias("part"), F.col("team_id").alias("team_pos"), F.col("pos"), F.col("team_id").alias("teamId"), F.col("team_name").alias("teamName"), F.col("player_name").alias("playerName"), "role", F.lit("SOLD").alias("status"),
        "price", "sequence", F.col("initial_purse").alias("initialPurse"), "spent", "remaining",
    )
    rest = unsold.select(F.lit(1).alias("part"), F.col("pos"), F.col("player_name").alias("playerName"), "role", F.lit("UNSOLD").alias("status"), "sequence")
    return sold.unionByName(rest, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """A folder of text parts that make one export in the order of their names: a byte-order mark and the header line first and once, then the rows
    by ``order``, every line ended by CRLF. Rows are sorted by ranges, so an export of any size is written by many tasks; empty parts are not written."""
    header = F.lit("\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in columns))
    keys = [f"_k{i}" for i in range(len(order or []))]
    rows = df.select(F.lit(1).alias("_part"), *[F.col(c).alias(k) for c, k in zip(order or [], keys, strict=True)], F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))
    first = df.sparkSession.range(1).select(F.lit(0).alias("_part"), header.alias("line"))
    out = first.unionByName(rows, allowMissingColumns=True).orderBy("_part", *keys)
    out.select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def report_json(header: dict[str, str], teams: DataFrame, squads: DataFrame, players: DataFrame, sales: DataFrame, tx: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(section, key, json): the final report, one JSON document a header, summary, team, unsold player and transaction, so that no task holds the whole
    report. teams: team_id, name, owner, active and finance columns; squads: team_id, player_id, player_name, role, price, sequence, pos; players:
    player_id, name, role, base_price, status, team_id, price, sequence."""
    row = lambda section, key, *cols: (F.lit(section).alias("section"), key.cast("string").alias("key"), F.to_json(F.struct(*cols)).alias("json"))
    spark = teams.sparkSession
    head = spark.range(1).select(*row("auction", F.lit(""), *[F.lit(v).alias(k) for k, v in header.items()]))
    sold = lambda c: F.when(F.col("status") == "sold", c)
    best = F.max_by(sold(F.struct(F.col("player_id").alias("id"), "name", "role", F.col("price").alias("salePrice"))), sold(F.struct("price", -F.col("player_id"))))
    people = players.agg(F.count("*").alias("players"), F.count_if(F.col("status") == "sold").alias("sold"), F.count_if(F.col("status") == "unsold").alias("unsold"), best.alias("highestPricedPlayer"))
    n, total = F.count("*"), F.coalesce(F.sum("price"), F.lit(0))
    money = sales.agg(total.alias("totalExpenditure"), F.when(n == 0, F.lit(0).cast("long")).otherwise(F.floor(total / n + F.lit(0.5))).alias("averageSalePrice"))
    active = teams.agg(F.count_if("active").alias("teams"))
    # three rows of one row each
    summary = active.join(F.broadcast(people), F.lit(True)).join(F.broadcast(money), F.lit(True)).select(*row("summary", F.lit(""), "teams", "players", "sold", "unsold", "totalExpenditure", "averageSalePrice", "highestPricedPlayer"))
    member = F.struct("pos", F.col("player_id").alias("id"), F.col("player_name").alias("name"), "role", "price", "sequence")
    lists = squads.groupBy(F.col("team_id").alias("_t")).agg(F.sort_array(F.collect_list(member)).alias("_m"), *[F.count_if(F.col("role") == r).alias(f"_{r}") for r in roles])
    squad = F.transform(F.coalesce("_m", F.array().cast(f"array<{dict(lists.dtypes)['_m'][6:-1]}>")), lambda m: m.dropFields("pos"))
    counts = F.struct(*[F.coalesce(F.col(f"_{r}"), F.lit(0).cast("long")).alias(r) for r in roles])
    team = teams.join(lists, F.col("team_id") == F.col("_t"), "left").select(
        *row("team", F.col("team_id"), F.col("team_id").alias("id"), "name", "owner", F.col("initial_purse").alias("initialPurse"), "spent", "remaining", F.col("purchased").alias("squadSize"), counts.alias("roleCounts"), squad.alias("squad"))
    )
    unsold = players.where("status = 'unsold'").select(*row("unsold", F.col("player_id"), F.col("player_id").alias("id"), "name", "role", F.col("base_price").alias("basePrice"), "sequence"))
    log = tx.select(*row("transaction", F.col("sequence"), *[F.col(c) for c in tx.columns]))
    return head.unionByName(summary).unionByName(team).unionByName(unsold).unionByName(log)


def snapshot_summary(teams: DataFrame, tx: DataFrame) -> DataFrame:
    """Counts of each owner group's teams and active sales."""
    sales = tx.where("type = 'sale' and not reversed").groupBy(F.col("team_id").alias("_t")).agg(F.count("*").alias("_n"))
    return teams.join(sales, F.col("team_id") == F.col("_t"), "left").groupBy("owner").agg(F.count("*").alias("teams"), F.coalesce(F.sum("_n"), F.lit(0)).alias("active_sales"))


def export_state(df: DataFrame, secrets: list[str]) -> DataFrame:
    """JSON documents without credential columns."""
    return df.drop(*secrets).select(F.to_json(F.struct("*")).alias("json"))
