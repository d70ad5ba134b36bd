"""Integrals over depth-ordered profiles: one shuffle by location, windows inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.functions import soil


def _ordered(loc: list[str], depth: str):
    return Window.partitionBy(*loc).orderBy(depth)


def ascending(df: DataFrame, loc: list[str], depth: str) -> DataFrame:
    """(loc, ok): whether a location's depths, in the order given by `depth`, never repeat; one sample is ascending."""
    step = F.col(depth) - F.lag(depth).over(_ordered(loc, depth))
    return df.select(*loc, step.alias("_s")).groupBy(*loc).agg(F.coalesce(F.bool_and(F.col("_s") > 0), F.lit(True)).alias("ok"))


def trapezoid(df: DataFrame, loc: list[str], depth: str, value: Column, name: str, limit: float | None = None) -> DataFrame:
    """(loc, name): the trapezoid integral of value over depth, to the last sample at or above the limit; 0 for one sample."""
    d = df.select(*loc, F.col(depth).alias("_z"), value.alias("_f"))
    if limit is not None:
        d = d.where(F.col("_z") <= limit)
    w = _ordered(loc, "_z")
    part = 0.5 * (F.col("_f") + F.lag("_f").over(w)) * (F.col("_z") - F.lag("_z").over(w))
    return d.select(*loc, part.alias("_p")).groupBy(*loc).agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias(name))


def liquefaction_potential(df: DataFrame, loc: list[str], depth: str, n: str, table: str, pga: float, *, fines: float = 5.0, magnitude: float = 7.5, skip_bad: bool = False) -> DataFrame:
    """(loc, lpi, risk): Iwasaki's index over the upper 20 m. Locations of fewer than two samples are left out.

    Samples above the water table count as safe. A pga of 0 or less is an error, and so is a repeated depth; with skip_bad
    locations with repeated depths or depths or counts that are NULL or not finite are left out, as maps of cells need it.
    """
    if pga <= 0:
        raise ValueError("pga must be positive")
    z, water = F.col(depth), F.col(table)
    _, effective = soil.stresses(z, water)
    safety = soil.resistance_ratio(soil.corrected_n(F.col(n), effective), fines=fines, magnitude=magnitude) / F.greatest(soil.stress_ratio(z, water, pga), F.lit(1e-3))
    wet = water.isNotNull() & ~F.isnan(water) & (z > water)
    severity = F.when(wet, F.greatest(F.lit(0.0), 1 - safety)).otherwise(0.0) * F.greatest(F.lit(0.0), 10 - 0.5 * z)
    w = _ordered(loc, "_z")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    d = df.select(*loc, z.alias("_z"), severity.alias("_f"), (finite(z) & finite(F.col(n))).alias("_ok"))
    step = F.col("_z") - F.lag("_z").over(w)
    again = F.lit(None) if skip_bad else F.when(step.isNotNull(), F.raise_error(F.lit("repeated depth")).cast("double"))
    part = F.when(F.col("_z") <= 20, 0.5 * (F.col("_f") + F.lag("_f").over(w)) * F.when(step > 0, step).otherwise(again))
    g = d.select(*loc, part.alias("_p"), F.coalesce(F.col("_ok") & (step.isNull() | (step > 0)), F.lit(False)).alias("_ok"))
    g = g.groupBy(*loc).agg(F.count("*").alias("_n"), F.coalesce(F.sum("_p"), F.lit(0.0)).alias("lpi"), F.bool_and("_ok").alias("_ok")).where("_n >= 2")
    g = (g.where("_ok") if skip_bad else g).drop("_n", "_ok")
    return g.withColumn("risk", soil.risk_class(F.col("lpi")))


def vs30(df: DataFrame, loc: list[str], depth: str, n: str, relation: str = "imai_tonouchi") -> DataFrame:
    """(loc, vs30, site): 30 m over the travel time; the last velocity goes on below. Locations need two samples."""
    w = _ordered(loc, depth)
    v = soil.shear_velocity(F.col(n), relation)
    above = F.coalesce(F.lag(depth).over(w), F.lit(0.0))
    thick = F.greatest(F.lit(0.0), F.least(F.col(depth), F.lit(30.0)) - above)
    d = df.select(*loc, F.col(depth).alias("_z"), v.alias("_v"), (thick / v).alias("_t"))
    rest = F.greatest(F.lit(0.0), 30 - F.max("_z")) / F.max_by("_v", "_z")
    g = d.groupBy(*loc).agg(F.count("*").alias("_n"), (30 / (F.sum("_t") + rest)).alias("vs30")).where("_n >= 2").drop("_n")
    return g.withColumn("site", soil.site_class(F.col("vs30")))


def bearing(df: DataFrame, loc: list[str], depth: str, n: str, design: float = 30.0, **footing) -> DataFrame:
    """(loc, stratum, qa, quality): the first depth with N of the design value, infinite if none, and its bearing pressure."""
    hit = F.col(n) >= design
    g = df.groupBy(*loc).agg(F.coalesce(F.min(F.when(hit, F.col(depth))), F.lit(float("inf"))).alias("stratum"), F.min_by(F.when(hit, F.col(n)), F.when(hit, F.col(depth))).alias("_n"))
    q = soil.allowable_bearing(F.col("_n"), **footing)
    return g.select(*loc, "stratum", q.alias("qa"), soil.bearing_class(q).alias("quality"))
