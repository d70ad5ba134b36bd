"""Inputs of the queries: the driver's tables seen as measurements, intervals, located points, profiles, predictions.

Each is a Spark builder and a DuckDB common table expression over the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corelog.registry import table

_POINTS = [
    "c_custkey AS id", "30 + ((c_custkey * 7919) % 10000) / 1e3 AS lat", "130 + ((c_custkey * 104729) % 10000) / 1e3 AS lon",
    "c_nationkey AS code", "c_mktsegment AS seg", "c_acctbal AS v",
]
_PREDICTIONS = [
    "o_orderkey AS row_id", "o_custkey AS unit", "o_orderpriority AS regime", "o_totalprice / 1e3 AS y",
    "100 + (o_custkey % 97) / 1e0 AS mu", "40 + (o_orderkey % 13) / 1e0 AS sd",
]
_GRID = ["CAST(c_custkey % 50 AS INT) AS i", "CAST(floor(c_custkey / 50e0) AS INT) AS j", "CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS value", "CAST(c_custkey % 7 AS INT) AS code"]
_PROFILE = ["l_orderkey AS loc", "l_linenumber * 3e0 AS depth", "max(l_quantity) AS n"]

POINTS = f"points AS (SELECT {', '.join(_POINTS)} FROM customer)"
PREDICTIONS = f"predictions AS (SELECT {', '.join(_PREDICTIONS)} FROM orders)"
GRID = f"grid AS (SELECT {', '.join(_GRID)} FROM customer)"
PROFILE = f"profile AS (SELECT {', '.join(_PROFILE)} FROM lineitem GROUP BY l_orderkey, l_linenumber)"
EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) - 1704067200000000 AS pos FROM events)"
LAYERS = "layers AS (SELECT user_id, event_id AS layer_id, pos AS top, pos + 86400000000 * (1 + event_id % 5) AS bottom FROM ev WHERE event_type = 'signup')"
PURCHASES = "purchases AS (SELECT event_id, user_id, pos, value FROM ev WHERE event_type = 'purchase')"


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, lat, lon, code, seg, v): customers with invented coordinates."""
    return table(spark, d, "customer").selectExpr(*_POINTS)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, unit, regime, y, mu, sd): orders with an invented prediction."""
    return table(spark, d, "orders").selectExpr(*_PREDICTIONS)


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, value, code): a raster of account balances with holes."""
    return table(spark, d, "customer").selectExpr(*_GRID)


def profile(spark: SparkSession, d: str) -> DataFrame:
    """(loc, depth, n): an order's lines as an ordered profile, equal places merged."""
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS loc", "l_linenumber * 3e0 AS depth", "l_quantity AS n").groupBy("loc", "depth").agg({"n": "max"}).withColumnRenamed("max(n)", "n")


def events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user_id, event_type, value, pos): `pos` in microseconds from 2024."""
    return table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", "value", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS pos")


def layers(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, layer_id, top, bottom): an interval of one to five days from each signup."""
    e = events(spark, d).where("event_type = 'signup'")
    return e.selectExpr("user_id", "event_id AS layer_id", "pos AS top", "pos + 86400000000 * (1 + event_id % 5) AS bottom")


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user_id, pos, value)."""
    return events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "pos", "value")
