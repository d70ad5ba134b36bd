"""Queries over depth-ordered profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelog.functions import soil
from corelog.operators import profiles as P
from corelog.queries.inputs import PROFILE, profile
from corelog.registry import query

_WET = "CASE WHEN loc % 5 <> 0 THEN (loc % 7) * 1e0 END"
_STRESS = f"""{PROFILE}, a AS (SELECT *, {_WET} AS water FROM profile), b AS (SELECT *, coalesce(depth > water, false) AS wet FROM a),
c AS (SELECT *, CASE WHEN wet THEN 17e0 * water + 19e0 * (depth - water) ELSE 17e0 * depth END AS total FROM b),
st AS (SELECT *, CASE WHEN wet THEN total - 9.81e0 * (depth - water) ELSE total END AS eff,
greatest(0.05e0, least(1e0, CASE WHEN depth < 9.15e0 THEN 1 - 0.00765e0 * depth ELSE 1.174e0 - 0.0267e0 * depth END)) AS rd FROM c),
r AS (SELECT *, 0.65e0 * 0.2e0 * (total / greatest(eff, 1e-3)) * rd AS csr, n * least(sqrt(101.325e0 / greatest(eff, 1)), 1.7e0) AS n1 FROM st),
q AS (SELECT *, CASE WHEN n1 + 1.5e0 >= 30 THEN 2e0 ELSE (1 / (34 - least(n1 + 1.5e0, 29.99e0)) + least(n1 + 1.5e0, 29.99e0) / 135 + 50 / pow(10 * least(n1 + 1.5e0, 29.99e0) + 45, 2) - 0.005e0)
* (pow(10e0, 2.24e0) / pow(7.5e0, 2.56e0)) END AS crr FROM r)"""


def _wet(s, d):
    return profile(s, d).withColumn("water", F.when(F.col("loc") % 5 != 0, (F.col("loc") % 7).cast("double")))


@query(f"WITH {_STRESS} SELECT loc, depth, round(total, 4) AS total, round(eff, 4) AS effective, round(rd, 6) AS rd, round(csr, 6) AS csr, round(n1, 4) AS n1, round(crr, 6) AS crr FROM q")
def cyclic_ratios(s, d):
    """Stresses, cyclic stress and resistance of each sample."""
    p, z, w = _wet(s, d), F.col("depth"), F.col("water")
    total, eff = soil.stresses(z, w)
    n1 = soil.corrected_n(F.col("n"), eff)
    return p.select("loc", "depth", F.round(total, 4).alias("total"), F.round(eff, 4).alias("effective"), F.round(soil.reduction(z), 6).alias("rd"), F.round(soil.stress_ratio(z, w, 0.2), 6).alias("csr"), F.round(n1, 4).alias("n1"), F.round(soil.resistance_ratio(n1, fines=15.0), 6).alias("crr"))


@query(f"""WITH {_STRESS}, f AS (SELECT loc, depth, CASE WHEN wet THEN greatest(0, 1 - crr / greatest(csr, 1e-3)) ELSE 0 END * greatest(0, 10 - 0.5e0 * depth) AS f FROM q),
t AS (SELECT loc, depth, 0.5e0 * (f + lag(f) OVER w) * (depth - lag(depth) OVER w) AS part FROM f WINDOW w AS (PARTITION BY loc ORDER BY depth)),
g AS (SELECT loc, coalesce(sum(CASE WHEN depth <= 20 THEN part END), 0) AS lpi FROM t GROUP BY loc HAVING count(*) >= 2)
SELECT loc, round(lpi, 4) AS lpi, CASE WHEN lpi <= 0 THEN 'very_low' WHEN lpi <= 5 THEN 'low' WHEN lpi <= 15 THEN 'high' ELSE 'very_high' END AS risk FROM g""")
def liquefaction_index(s, d):
    """The index of each profile and its class."""
    return P.liquefaction_potential(_wet(s, d), ["loc"], "depth", "n", "water", 0.2, fines=15.0).withColumn("lpi", F.round("lpi", 4))


@query(f"""WITH {_STRESS}, f AS (SELECT loc, depth, CASE WHEN wet THEN greatest(0, 1 - crr / greatest(csr, 1e-3)) ELSE 0 END * greatest(0, 10 - 0.5e0 * depth) AS f FROM q),
t AS (SELECT loc, depth, 0.5e0 * (f + lag(f) OVER w) * (depth - lag(depth) OVER w) AS part FROM f WINDOW w AS (PARTITION BY loc ORDER BY depth)),
g AS (SELECT loc, coalesce(sum(CASE WHEN depth <= 20 THEN part END), 0) AS lpi FROM t WHERE loc NOT IN (SELECT loc FROM profile WHERE depth = 3 AND loc % 11 = 0) GROUP BY loc HAVING count(*) >= 2)
SELECT loc, round(lpi, 4) AS lpi, CASE WHEN lpi <= 0 THEN 'very_low' WHEN lpi <= 5 THEN 'low' WHEN lpi <= 15 THEN 'high' ELSE 'very_high' END AS risk FROM g""")
def liquefaction_map(s, d):
    """The index of each cell of a map; cells with a missing sample are skipped, they don't stop the others."""
    bad = _wet(s, d).withColumn("n", F.when((F.col("depth") == 3) & (F.col("loc") % 11 == 0), F.lit(None)).otherwise(F.col("n")))
    return P.liquefaction_potential(bad, ["loc"], "depth", "n", "water", 0.2, fines=15.0, skip_bad=True).withColumn("lpi", F.round("lpi", 4))


@query(f"""WITH {PROFILE}, a AS (SELECT *, 97e0 * pow(greatest(n, 1), 0.314e0) AS v, coalesce(lag(depth) OVER (PARTITION BY loc ORDER BY depth), 0) AS up FROM profile),
g AS (SELECT loc, 30 / (sum(greatest(0, least(depth, 30) - up) / v) + greatest(0, 30 - max(depth)) / arg_max(v, depth)) AS vs FROM a GROUP BY loc HAVING count(*) >= 2)
SELECT loc, round(vs, 4) AS vs30, CASE WHEN vs > 1500 THEN 'A' WHEN vs > 760 THEN 'B' WHEN vs > 360 THEN 'C' WHEN vs > 180 THEN 'D' ELSE 'E' END AS site FROM g""")
def average_velocity(s, d):
    """Velocity over the upper 30 m and the site class."""
    return P.vs30(profile(s, d), ["loc"], "depth", "n").withColumn("vs30", F.round("vs30", 4))


@query(f"""WITH {PROFILE}, g AS (SELECT loc, min(CASE WHEN n >= 30 THEN depth END) AS z, arg_min(n, depth) FILTER (WHERE n >= 30) AS n FROM profile GROUP BY loc),
q AS (SELECT loc, z, CASE WHEN n > 0 THEN n * (7.99e0 * pow((2 + 0.305e0) / 2, 2) * least(1.33e0, 1 + 0.33e0 / 2) / 1e0) END AS qa FROM g)
SELECT loc, coalesce(z, 999) AS stratum, round(qa, 4) AS qa, CASE WHEN qa < 100 THEN 'very_poor' WHEN qa < 200 THEN 'poor' WHEN qa < 400 THEN 'good' WHEN qa IS NOT NULL THEN 'excellent' END AS quality FROM q""")
def bearing_stratum(s, d):
    """The first bearing depth (999 stands for none) and its pressure."""
    b = P.bearing(profile(s, d), ["loc"], "depth", "n", width=2.0)
    return b.select("loc", F.when(F.col("stratum") == float("inf"), 999.0).otherwise(F.col("stratum")).alias("stratum"), F.round("qa", 4).alias("qa"), "quality")
