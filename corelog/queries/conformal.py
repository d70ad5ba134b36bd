"""Queries over calibration: predictions, a split by hashed order, quantiles, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelog.operators import aggregates as A
from corelog.operators import conformal as C
from corelog.operators.common import bounded, hashed
from corelog.operators.quantiles import order_statistics
from corelog.queries.inputs import POINTS, PREDICTIONS, points, predictions
from corelog.registry import query

_SCORED = f"{PREDICTIONS}, s AS (SELECT *, abs(y - mu) / sd AS score, md5('42|' || unit) < '8' AS cal FROM predictions)"


def _scored(s, d):
    return predictions(s, d).withColumns({"score": F.abs(F.col("y") - F.col("mu")) / F.col("sd"), "cal": hashed(42, "unit") < "8"})


@query(f"""WITH {PREDICTIONS}, g AS (SELECT var_pop(y) AS v FROM predictions)
SELECT regime, count(*) AS n, round(sqrt(avg((y - mu) * (y - mu))), 6) AS rmse, round(avg(abs(y - mu)), 6) AS mae, round(1 - avg((y - mu) * (y - mu)) / max(v), 6) AS r2,
round(avg(-0.5e0 * (ln(2 * pi()) + 2 * ln(sd) + pow((y - mu) / sd, 2))), 6) AS log_lik, round(var_pop((y - mu) / sd), 6) AS z_var FROM predictions, g GROUP BY regime""")
def regime_metrics(s, d):
    """A7."""
    m = A.regime_metrics(predictions(s, d), "regime", "y", "mu", "sd")
    return m.select("regime", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2", "log_lik", "z_var")])


@query(f"""WITH {PREDICTIONS} SELECT alpha, round(avg(CASE WHEN abs(y - mu) <= z * sd THEN 1 ELSE 0 END), 6) AS empirical
FROM predictions, (VALUES (0.5e0, 0.6744897501960817e0), (0.8e0, 1.2815515655446008e0), (0.95e0, 1.959963984540054e0)) AS a(alpha, z) GROUP BY alpha""")
def reliability_table(s, d):
    """Coverage at three levels, in one scan."""
    return C.reliability(predictions(s, d), "y", "mu", "sd", [0.5, 0.8, 0.95]).withColumn("empirical", F.round("empirical", 6))


@query(f"WITH {PREDICTIONS} SELECT round(sqrt(avg(pow((y - mu) / sd, 2))), 6) AS temperature FROM predictions")
def temperature_scale(s, d):
    """A10."""
    return predictions(s, d).agg(F.round(C.temperature("y", "mu", "sd"), 6).alias("temperature"))


@query(f"""WITH {_SCORED}, o AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s WHERE cal)
SELECT n, round(score, 6) AS q FROM o WHERE r = greatest(1, least(n, ceil((n + 1) * 0.8e0)))""")
def conformal_quantile(s, d):
    """The exact order statistic of all calibration scores."""
    return C.order_statistic(_scored(s, d).where("cal"), [], "score", 0.8).select("n", F.round("q", 6).alias("q"))


_QUANTILES = f"""{_SCORED}, o AS (SELECT regime, score, row_number() OVER (PARTITION BY regime ORDER BY score) AS r, count(*) OVER (PARTITION BY regime) AS n FROM s WHERE cal),
gq AS (SELECT regime, score AS q FROM o WHERE n >= 30 AND r = greatest(1, least(n, ceil((n + 1) * 0.8e0)))),
m AS (SELECT score AS q FROM (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s WHERE cal) WHERE r = greatest(1, least(n, ceil((n + 1) * 0.8e0)))),
t AS (SELECT s.*, mu - coalesce(gq.q, m.q) * sd AS low, mu + coalesce(gq.q, m.q) * sd AS high FROM s LEFT JOIN gq USING (regime), m WHERE NOT cal)"""


def _intervals(s, d):
    sc = _scored(s, d)
    q, marginal = C.mondrian(sc.where("cal"), "regime", "score", 0.8)
    return C.mondrian_interval(sc.where("NOT cal"), q, marginal, "regime", "mu", "sd")


@query(f"WITH {_QUANTILES} SELECT row_id, round(low, 6) AS low, round(high, 6) AS high FROM t")
def mondrian_intervals(s, d):
    """Intervals by the regime's exact quantile, the marginal one for small regimes."""
    return _intervals(s, d).select("row_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {_QUANTILES} SELECT regime, count(*) AS n, round(avg(CASE WHEN y BETWEEN low AND high THEN 1 ELSE 0 END), 6) AS covered, round(avg(high - low), 6) AS width,
round(avg(high - low + 10 * (greatest(0, low - y) + greatest(0, y - high))), 6) AS winkler FROM t GROUP BY regime""")
def mondrian_report(s, d):
    """Coverage, width and interval score by regime."""
    covered = F.col("y").between(F.col("low"), F.col("high"))
    return _intervals(s, d).groupBy("regime").agg(F.count("*").alias("n"), F.round(A.share(covered), 6).alias("covered"), F.round(F.avg(F.col("high") - F.col("low")), 6).alias("width"), F.round(C.winkler("y", "low", "high", 0.8), 6).alias("winkler"))


@query(f"""WITH {_SCORED}, u AS (SELECT 'row' AS split, score, md5('7|' || row_id) < '8' AS cal FROM s UNION ALL SELECT 'unit', score, md5('7|' || unit) < '8' FROM s UNION ALL SELECT 'site', score, md5('7|' || (unit % 100)) < '8' FROM s),
o AS (SELECT split, score, row_number() OVER (PARTITION BY split ORDER BY score) AS r, count(*) OVER (PARTITION BY split) AS n FROM u WHERE cal),
q AS (SELECT split, score AS q FROM o WHERE r = greatest(1, least(n, ceil((n + 1) * 0.95e0))))
SELECT split, count(*) AS n_test, round(max(q), 6) AS q, round(avg(CASE WHEN score <= q THEN 1 ELSE 0 END), 6) AS covered FROM u JOIN q USING (split) WHERE NOT cal GROUP BY split""")
def split_unit_report(s, d):
    """Coverage when rows, whole units or whole sites are split."""
    units = F.array(*[F.struct(F.lit(n).alias("split"), (hashed(7, k) < "8").alias("cal")) for n, k in (("row", F.col("row_id")), ("unit", F.col("unit")), ("site", F.col("unit") % 100))])
    u = _scored(s, d).select("score", F.explode(units).alias("u")).select("score", "u.*")
    q = C.order_statistic(u.where("cal"), ["split"], "score", 0.95).drop("n")
    t = u.where("NOT cal").join(bounded(q), "split")
    return t.groupBy("split").agg(F.count("*").alias("n_test"), F.round(F.max("q"), 6).alias("q"), F.round(A.share(F.col("score") <= F.col("q")), 6).alias("covered"))


_SPLITS = "u AS (SELECT split, seed, score, md5(seed || '|' || k) < '8' AS cal FROM (SELECT 'row' AS split, row_id AS k, score FROM s UNION ALL SELECT 'unit', unit, score FROM s UNION ALL SELECT 'site', unit % 100, score FROM s), (VALUES (7), (8), (9)) AS t(seed))"


@query(f"""WITH {_SCORED}, {_SPLITS}, l AS (SELECT * FROM (VALUES (0.5e0), (0.8e0), (0.95e0)) AS t(alpha)),
o AS (SELECT split, seed, score, row_number() OVER (PARTITION BY split, seed ORDER BY score) AS r, count(*) OVER (PARTITION BY split, seed) AS n FROM u WHERE cal),
q AS (SELECT split, seed, alpha, score AS q FROM o, l WHERE r = greatest(1, least(n, ceil((n + 1) * alpha)))),
c AS (SELECT split, alpha, seed, avg(CASE WHEN score <= q THEN 1 ELSE 0 END) AS covered, max(q) AS q FROM u JOIN q USING (split, seed) WHERE NOT cal GROUP BY ALL)
SELECT split, alpha, count(*) AS n_seeds, round(avg(covered), 6) AS mean_covered, round(max(abs(covered - alpha)), 6) AS worst, round(avg(q), 6) AS mean_q FROM c GROUP BY split, alpha""")
def coverage_report(s, d):
    """Coverage over split units, seeds and levels: all quantiles of a (unit, seed) group come from one pass."""
    alphas = [0.5, 0.8, 0.95]
    units = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(seed).alias("seed"), (hashed(seed, k) < "8").alias("cal")) for n, k in (("row", F.col("row_id")), ("unit", F.col("unit")), ("site", F.col("unit") % 100)) for seed in (7, 8, 9)])
    u = _scored(s, d).select("score", F.explode(units).alias("u")).select("score", "u.*")
    place = lambda a: lambda n: F.greatest(F.lit(1), F.least(n, F.ceil((n + 1) * a)))
    q = order_statistics(u.where("cal"), ["split", "seed"], "score", {f"q{i}": place(a) for i, a in enumerate(alphas)})
    q = q.select("split", "seed", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"q{i}").alias("q")) for i, a in enumerate(alphas)])).alias("l")).select("split", "seed", "l.*")
    c = u.where("NOT cal").join(bounded(q), ["split", "seed"]).groupBy("split", "seed", "alpha").agg(A.share(F.col("score") <= F.col("q")).alias("covered"), F.max("q").alias("q"))
    return c.groupBy("split", "alpha").agg(F.count("*").alias("n_seeds"), F.round(F.avg("covered"), 6).alias("mean_covered"), F.round(F.max(F.abs(F.col("covered") - F.col("alpha"))), 6).alias("worst"), F.round(F.avg("q"), 6).alias("mean_q"))


@query(f"""WITH {_SCORED}, t AS (SELECT 'price' AS task, regime, score, cal FROM s UNION ALL SELECT 'level', regime, abs(mu - 140) / sd, cal FROM s WHERE row_id % 3 = 0),
o AS (SELECT task, regime, score, row_number() OVER (PARTITION BY task, regime ORDER BY score) AS r, count(*) OVER (PARTITION BY task, regime) AS n FROM t WHERE cal)
SELECT task, regime, n, round(score, 6) AS q FROM o WHERE r = greatest(1, least(n, ceil((n + 1) * 0.5e0)))""")
def two_task_quantiles(s, d):
    """Two tasks stacked, each over the rows where it was observed (the second for a third of them)."""
    sc = _scored(s, d)
    t = sc.selectExpr("'price' AS task", "regime", "score", "cal").unionByName(sc.where("row_id % 3 = 0").selectExpr("'level' AS task", "regime", "abs(mu - 140) / sd AS score", "cal"))
    return C.order_statistic(t.where("cal"), ["task", "regime"], "score", 0.5).withColumn("q", F.round("q", 6))


_RUN = "w AS (SELECT regime, score, 1e0 * (1 + unit % 5) AS weight FROM s WHERE cal), r AS (SELECT regime, score, sum(weight) OVER (PARTITION BY regime ORDER BY score) AS run, sum(weight) OVER (PARTITION BY regime) AS total FROM w)"


@query(f"WITH {_SCORED}, {_RUN} SELECT regime, round(min(score) FILTER (WHERE run / total >= 0.8e0 - 1e-12), 6) AS q FROM r GROUP BY regime")
def weighted_quantiles(s, d):
    """The least score whose cumulative weight reaches 0.8."""
    w = _scored(s, d).where("cal").withColumn("weight", 1.0 + F.col("unit") % 5)
    return C.weighted_quantile(w, ["regime"], "score", "weight", 0.8).withColumn("q", F.round("q", 6))


@query(f"""WITH {_SCORED}, {_RUN}, t AS (SELECT row_id, regime, 1e0 * (1 + row_id % 900) AS w FROM s WHERE NOT cal),
hit AS (SELECT t.row_id, min(score) FILTER (WHERE run >= 0.9e0 * (total + w) - 1e-9) AS q FROM t JOIN r USING (regime) GROUP BY t.row_id)
SELECT row_id, coalesce(round(q, 6), 999) AS q FROM hit""")
def shifted_row_quantiles(s, d):
    """Every test row with its own weight at infinity; 999 stands for an unbounded interval."""
    sc = _scored(s, d)
    w = sc.where("cal").withColumn("weight", 1.0 + F.col("unit") % 5)
    t = sc.where("NOT cal").withColumn("w", 1.0 + F.col("row_id") % 900)
    q = C.shifted_quantile(t, w, "row_id", ["regime"], "score", "weight", "w", 0.9)
    return q.select("row_id", F.when(F.col("q") == float("inf"), 999.0).otherwise(F.round("q", 6)).alias("q"))


@query()
def isotonic_levels(s, d):
    """Nominal levels, their recalibrated ones, and the level whose recalibrated one is the nominal (the inverse)."""
    z = predictions(s, d).select(((F.col("y") - F.col("mu")) / F.col("sd")).alias("z"))
    grid, level = C.isotonic(z, "z", 201)
    back = C.inverse_levels(grid, level, grid)
    return s.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(grid, level, back)], "level double, recalibrated double, inverse double")


@query(f"""WITH {_SCORED}, {_RUN} SELECT regime, coalesce(round(min(score) FILTER (WHERE run / (total + 500) >= 0.9e0 - 1e-12), 6), 999) AS q FROM r GROUP BY regime""")
def shifted_quantiles(s, d):
    """The same with the test point's weight of 500 at infinity; 999 stands for an unbounded interval."""
    w = _scored(s, d).where("cal").withColumn("weight", 1.0 + F.col("unit") % 5)
    q = C.weighted_quantile(w, ["regime"], "score", "weight", 0.9, atom=500.0)
    return q.withColumn("q", F.when(F.col("q") == float("inf"), 999.0).otherwise(F.round("q", 6)))


@query(f"""WITH {PREDICTIONS}, z AS (SELECT regime, (y - mu) / sd AS z FROM predictions)
SELECT regime, round(avg(z * z), 6) AS mean_z2, round(kurtosis_pop(z) + 3, 4) AS kurtosis, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(abs(z), 0.95), 6) AS q95_abs FROM z GROUP BY regime""")
def z_diagnostics(s, d):
    """A32."""
    z = predictions(s, d).withColumn("z", (F.col("y") - F.col("mu")) / F.col("sd"))
    g = A.z_diagnostics(z, "z", ["regime"])
    return g.select("regime", F.round("mean_z2", 6).alias("mean_z2"), F.round("kurtosis", 4).alias("kurtosis"), F.round("median", 6).alias("median"), F.round("q95_abs", 6).alias("q95_abs"))


@query(f"""WITH {POINTS}, s AS (SELECT id, lat, lon, abs(v) / 5000 AS score, md5('42|' || id) < '8' AS cal FROM points),
p AS (SELECT t.id, c.score, exp(-(pow(t.lat - c.lat, 2) + pow(t.lon - c.lon, 2)) / 0.5e0) AS w FROM s t, s c WHERE NOT t.cal AND c.cal),
r AS (SELECT id, score, sum(w) OVER (PARTITION BY id ORDER BY score) AS run, sum(w) OVER (PARTITION BY id) AS total FROM p)
SELECT id, round(coalesce(min(score) FILTER (WHERE run / total >= 0.8e0 - 1e-12), max(score)), 6) AS q FROM r GROUP BY id""")
def local_quantiles(s, d):
    """The weighted quantile around each test point, with kernel weights over all calibration points."""
    p = points(s, d).withColumns({"score": F.abs("v") / 5000, "cal": hashed(42, "id") < "8"})
    return C.local_quantiles(p.where("NOT cal"), p.where("cal"), "id", ["lat", "lon"], "score", 0.8, 0.5).withColumn("q", F.round("q", 6))
