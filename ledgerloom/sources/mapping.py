"""The ledger's tables as views over the analytic test schema.

Money is whole numbers from here on. A transaction is a sale (status F), a reversed sale (P) or an unsold lot (O, without a team).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The roles of the pool, in the order of report columns.
ROLES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: str, scale: int = 1) -> Column:
    return F.round(F.col(col) * scale).cast("long")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("owner"), whole("c_acctbal", 100).alias("initial_purse"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sequence"),
        F.col("o_orderdate").alias("ts"),
        F.when(status == "O", "unsold").otherwise("sale").alias("type"),
        (status == "P").alias("reversed"),
        F.when(status != "O", F.col("o_custkey")).alias("team_id"),
        F.when(status != "O", whole("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("note"),
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_type").alias("role"), F.col("p_brand").alias("category"), whole("p_retailprice", 100).alias("base_price"))


def squad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each lot line: team, player, status, price. (lot, line) isn't a key."""
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lot"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("team_id"),
        F.col("l_partkey").alias("player_id"),
        F.when(flag == "N", "sold").when(flag == "R", "unsold").otherwise("available").alias("status"),
        F.col("l_quantity").alias("quantity"),
        whole("l_extendedprice", 100).alias("price"),
        F.col("l_shipdate").alias("ts"),
    )


def franchises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"), whole("s_acctbal", 100).alias("initial_purse"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log: login (signup), failure (error), bid (click), view, sale (purchase)."""
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), whole("value", 100).alias("amount"))
