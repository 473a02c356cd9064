"""Plans stay as designed: pruned scans, pushed filters, no Cartesian products, no Python on the ledger side."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.plans.catalogue import QUERIES
from ledgerloom.session import shuffle_partitions
from ledgerloom.sources import mapping as M

DATA = "/root/testdata/sf0.001"
PYTHON = {"command_fold", "csv_ingest", "csv_team_ingest"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_no_python_and_no_cartesian_product(spark, name):
    p = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "BroadcastNestedLoopJoin" not in p or name in ("role_composition", "report_json")  # against a handful of role rules; a summary of one row


def test_scans_are_pruned_and_filters_pushed(spark):
    p = plan(ledger.active_sales(M.transactions(spark, DATA)).select("team_id", "price"))
    assert "o_orderdate" not in p.split("ReadSchema")[-1] and "o_orderpriority" not in p.split("ReadSchema")[-1]
    p = plan(M.players(spark, DATA).where(F.col("role") == "PROMO").select("player_id"))
    assert "EqualTo(p_type,PROMO)" in p


def test_partitions_follow_the_input():
    assert shuffle_partitions(1) == 8 and shuffle_partitions(100 << 40) == 819_200
