"""Validating CSV ingest: whole-file parse in a table function, binding and checks as column expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import clean_text, normal_role, parse_boolean, parse_integer, utf16_length

ID = r"^[a-z0-9][a-z0-9_-]{1,47}$"
PHOTO = r"^/uploads/[A-Za-z0-9._-]+$"
PLAYER_COLUMNS, TEAM_COLUMNS = ("id", "name", "role", "baseprice"), ("id", "name", "initialpurse")


def records(text: str) -> Iterator[list[str]]:
    """Records of a CSV text that are not blank. A quote opens a field only at its start; anything after the closing quote is kept."""
    field: list[str] = []
    row: list[str] = []
    quoted, i, n = False, 1 if text.startswith("﻿") else 0, len(text)
    while i < n:
        c = text[i]
        if quoted:
            j = text.find('"', i)
            if j < 0:
                raise ValueError("unclosed quote")
            field.append(text[i:j])
            if text[j + 1 : j + 2] == '"':
                field.append('"')
                i = j + 2
            else:
                quoted, i = False, j + 1
            continue
        if c == '"' and not any(field):
            quoted = True
        elif c == ",":
            row.append("".join(field))
            field = []
        elif c in "\r\n":
            row.append("".join(field))
            if any(x.strip() for x in row):
                yield row
            row, field = [], []
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
        else:
            field.append(c)
        i += 1
    if quoted:
        raise ValueError("unclosed quote")
    row.append("".join(field))
    if any(x.strip() for x in row):
        yield row


def parse(text: str) -> tuple[list[str], list[list[str]]]:
    rows = list(records(text))
    if not rows:
        raise ValueError("empty file")
    return [h.strip().lower() for h in rows[0]], rows[1:]


@udtf(returnType="file_error string, record_no int, cells map<string,string>")
class CsvRecords:
    """One row for each data record: header -> cell, the last of equal headers wins. A file that fails gives one row with its error."""

    def eval(self, text: str, required: str):
        try:
            header, rows = parse(text or "")
        except ValueError as e:
            yield str(e), None, None
            return
        missing = [c for c in required.split(",") if c not in header and not (c == "initialpurse" and "purse" in header)]
        if missing:
            yield f"missing columns: {', '.join(missing)}", None, None
            return
        for k, r in enumerate(rows):
            cells = dict(zip(header, r + [""] * (len(header) - len(r)), strict=False))
            if "initialpurse" not in cells and "purse" in cells:
                cells["initialpurse"] = cells["purse"]
            yield None, k, cells


def read_records(spark: SparkSession, files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(path, file_error, record_no, line, cells) from (path, text). The reported line is the record's ordinal + 2."""
    spark.udtf.register("ledgerloom_csv_records", CsvRecords)
    view = f"csv_files_{uuid.uuid4().hex}"  # a view of its own for each call
    files.createOrReplaceTempView(view)
    out = spark.sql(f"select path, t.* from {view}, lateral ledgerloom_csv_records(text, '{','.join(required)}') t")
    spark.catalog.dropTempView(view)
    return out.withColumn("line", F.col("record_no") + 2)


def _first_error(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in checks])


def _cell(name: str) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(name)), F.lit(""))


def _too_long(c: Column, n: int) -> Column:
    return utf16_length(c) > n


def preview_players(recs: DataFrame, existing: DataFrame) -> DataFrame:
    """Typed rows with ``error``: the first failing check, null if the row is good. A bad first occurrence doesn't make the next one a
    duplicate."""
    ident = F.lower(clean_text(_cell("id")))
    rows = recs.where("file_error is null").select(
        "path", "record_no", "line", ident.alias("player_id"), clean_text(_cell("name")).alias("name"), normal_role(_cell("role")).alias("role"), parse_integer(_cell("baseprice"), 1).alias("base_price"),
        F.nullif(F.trim(_cell("photo")), F.lit("")).alias("photo"), clean_text(_cell("secondaryrole")).alias("secondary_role"), clean_text(_cell("stats")).alias("stats"), clean_text(_cell("category")).alias("category"),
    )
    checks = [
        (~F.col("player_id").rlike(ID), "bad id"),
        (F.col("name") == "", "name is required"),
        (_too_long(F.col("name"), 100), "name is too long"),
        (F.col("role").isNull(), "unknown role"),
        (F.col("base_price").isNull(), "bad base price"),
        (F.col("photo").isNotNull() & ~F.coalesce(F.col("photo").rlike(PHOTO), F.lit(False)), "bad photo path"),
        (_too_long(F.col("secondary_role"), 40), "secondary role is too long"),
        (_too_long(F.col("stats"), 180), "stats are too long"),
        (_too_long(F.col("category"), 60), "category is too long"),
    ]
    rows = rows.withColumn("_own", _first_error(checks))
    known = existing.select(F.lower("player_id").alias("player_id")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "player_id", "left")
    good = F.col("_own").isNull() & F.col("_known").isNull()
    nth = F.sum(good.cast("int")).over(Window.partitionBy("path", "player_id").orderBy("record_no"))
    error = F.coalesce(F.col("_own"), F.when(F.col("_known"), "duplicate id in the pool"), F.when(nth > 1, "duplicate id in the file"))
    return rows.withColumn("error", error).drop("_own", "_known")


def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each file in order: one that is free takes its id and name unless an earlier row has them."""
    file, ids, names = object(), set(), set()
    for b in batches:
        out = []
        for path, no, ident, name, free in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if path != file:
                file, ids, names = path, set(), set()
            error = None if not free else "duplicate id in the file" if ident in ids else "duplicate name in the file" if name in names else None
            if free and error is None:
                ids.add(ident)
                names.add(name)
            out.append((path, no, error))
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["path", "record_no", "_inner"])


def preview_teams(recs: DataFrame, existing: DataFrame) -> DataFrame:
    """Like players, but ids and names are unique together: a row that is refused for its name doesn't claim its id.
    That is a walk over a file's rows in order, not a window; it keeps the ids and names of one file."""
    rows = recs.where("file_error is null").select(
        "path", "record_no", "line", F.lower(clean_text(_cell("id"))).alias("team_id"), clean_text(_cell("name")).alias("name"), clean_text(_cell("owner")).alias("owner"),
        parse_integer(_cell("initialpurse"), 1).alias("initial_purse"), parse_boolean(_cell("active")).alias("active"), F.nullif(F.trim(_cell("logo")), F.lit("")).alias("logo"), F.trim(_cell("pin")).alias("_pin"),
    )
    checks = [
        (F.col("active").isNull(), "active is no boolean"),
        (~F.col("team_id").rlike(ID), "bad id"),
        (F.col("name") == "", "name is required"),
        (_too_long(F.col("name"), 80), "name is too long"),
        (_too_long(F.col("owner"), 80), "owner is too long"),
        (F.col("initial_purse").isNull(), "bad purse"),
        (F.col("logo").isNotNull() & ~F.coalesce(F.col("logo").rlike(PHOTO), F.lit(False)), "bad logo path"),
        ((F.col("_pin") != "") & ~F.col("_pin").rlike(r"^\d{4,12}$"), "bad pin"),
    ]
    rows = rows.withColumn("_own", _first_error(checks)).drop("_pin")
    ids = existing.select(F.lower("team_id").alias("team_id")).distinct().withColumn("_id_known", F.lit(True))
    names = existing.select(F.lower(F.trim("name")).alias("_key")).distinct().withColumn("_name_known", F.lit(True))
    rows = rows.withColumn("_key", F.lower("name")).join(ids, "team_id", "left").join(names, "_key", "left")
    outer = F.coalesce(F.col("_own"), F.when(F.col("_id_known"), "duplicate id in the pool"), F.when(F.col("_name_known"), "duplicate name in the pool"))
    rows = rows.withColumn("_outer", outer)
    claims = rows.select("path", "record_no", "team_id", "_key", F.col("_outer").isNull().alias("_free"))
    verdict = claims.repartition("path").sortWithinPartitions("path", "record_no").mapInArrow(claim, "path string, record_no int, _inner string")
    out = rows.join(verdict, ["path", "record_no"])
    return out.withColumn("error", F.coalesce("_outer", "_inner")).drop("_own", "_outer", "_inner", "_key", "_id_known", "_name_known")


def commit(preview: DataFrame, recs: DataFrame) -> DataFrame:
    """All or nothing for each file: rows of files without any row or file error."""
    bad = preview.where("error is not null").select("path").unionByName(recs.where("file_error is not null").select("path")).distinct()
    return preview.join(bad, "path", "left_anti").drop("error")


def append(pool: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """The pool with the committed rows behind it; ids that the pool got meanwhile refuse the whole import."""
    clash = committed.join(pool.select(F.lower(F.col(key)).alias("_k")), F.lower(F.col(key)) == F.col("_k"), "left_semi")
    if clash.limit(1).count():
        raise ValueError("an id is in the pool already: nothing was imported")
    return pool.unionByName(committed.select(*[c for c in committed.columns if c in pool.columns]), allowMissingColumns=True)
