"""Exact order statistics of groups of any size, without a task that holds or sorts a large group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.operators.common import bounded, kept

#: A group's distinct values are cut into so many ranges; one range is one task's to rank.
RANGES = 64


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]], *, count: str | None = None) -> DataFrame:
    """(by, n, names): for each group its rows, and under each name the value at the place (from 1) that places[name](n) gives.

    Equal values are counted first, and that table is written, so df is computed once. A sketch of each group's distinct
    values cuts them into RANGES ranges; totals of the ranges tell in which one a place lies, and only those are ranked.
    NULL keys are a group; NULL and NaN values don't count. count: a column that says how often a row counts.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).alias("_x"), (F.col(count) if count else F.lit(1)).cast("bigint").alias("_c"))
    counts = kept(rows.groupBy(*keys, "_x").agg(F.sum("_c").alias("_c")), "counts")
    shares = F.array(*[F.lit((i + 1) / RANGES) for i in range(RANGES - 1)])
    edges = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.percentile_approx("_x", shares).alias("_e"))
    edges = bounded(edges.toDF(*[f"{k}r" for k in keys], "_n", "_e"), "edges")
    placed = counts.join(edges, _same(keys, [f"{k}r" for k in keys])) if keys else counts.crossJoin(F.broadcast(edges))
    placed = placed.select(*keys, "_n", "_x", "_c", F.size(F.filter("_e", lambda e: e < F.col("_x"))).alias("_b"))
    totals = placed.groupBy(*keys, "_n", "_b").agg(F.sum("_c").alias("_t"))
    run = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f(F.col("_n")).cast("bigint").alias("at")) for i, f in enumerate(places.values())]))
    wanted = totals.withColumn("_run", run).select(*[F.col(k).alias(f"{k}w") for k in keys], "_b", "_run", "_t", asked.alias("_p"))
    wanted = wanted.where((F.col("_p.at") <= F.col("_run")) & (F.col("_p.at") > F.col("_run") - F.col("_t")))
    wanted = wanted.select(*[f"{k}w" for k in keys], F.col("_b").alias("_bw"), F.col("_p.i").alias("_i"), (F.col("_p.at") - F.col("_run") + F.col("_t")).alias("_rest"))
    inside = placed.join(wanted, _same([*keys, "_b"], [*[f"{k}w" for k in keys], "_bw"]))
    seen = F.sum("_c").over(Window.partitionBy(*keys, "_b", "_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    hit = inside.withColumn("_s", seen).where(F.col("_s") >= F.col("_rest"))
    found = [F.min(F.when(F.col("_i") == i, F.col("_x"))).alias(name) for i, name in enumerate(places)]
    out = hit.groupBy(*keys, "_n").agg(*found)
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col("_n").alias("n"), *places)


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], *, count: str | None = None) -> DataFrame:
    """(by, n, names): percentiles with linear interpolation between the two neighbouring values, exact."""
    places = {}
    for name, p in shares.items():
        places[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * p) + 1
        places[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * p) + 1
    q = order_statistics(df, by, value, places, count=count)
    between = lambda name, p: F.col(f"_lo_{name}") + ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return q.select(*by, "n", *[between(name, p).alias(name) for name, p in shares.items()])
