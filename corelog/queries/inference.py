"""Queries over effects, p-values, learners, embeddings' geometry and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelog.functions import gates
from corelog.operators import inference as I
from corelog.operators import spatial
from corelog.queries.inputs import POINTS, PREDICTIONS, points, predictions
from corelog.registry import query, table

_ARMS = "a AS (SELECT regime, unit, (y - mu) * (y - mu) AS text, (y - 150) * (y - 150) AS null0 FROM predictions)"


def _arms(s, d):
    return predictions(s, d).selectExpr("regime", "unit", "(y - mu) * (y - mu) AS text", "(y - 150) * (y - 150) AS null0")


@query(f"""WITH {PREDICTIONS}, {_ARMS} SELECT regime, count(*) AS n, round(100 * (sqrt(avg(text)) - sqrt(avg(null0))) / sqrt(avg(null0)), 6) AS effect FROM a GROUP BY regime""")
def content_effects(s, d):
    """The effect on RMSE of one arm against another, by regime."""
    g = _arms(s, d).groupBy("regime")
    return g.agg(F.count("*").alias("n"), F.round(I.effect(F.sqrt(F.avg("text")), F.sqrt(F.avg("null0"))), 6).alias("effect"))


@query(None)
def bootstrap_interval(s, d):
    """Pooled effect with a bootstrap interval of whole units (seeded; tested against a plain loop)."""
    losses = I.group_losses(_arms(s, d), ["unit"], ["text", "null0"])
    return s.createDataFrame([tuple(round(x, 6) for x in I.bca_interval(losses, "text", "null0"))], "effect double, low double, high double")


_P = "p AS (SELECT user_id % 8 AS region, (1 + event_id % 97) / 1e2 AS p, value AS null_effect FROM events)"


@query(f"""WITH {_P} SELECT region, round(0.5 - atan(avg(tan((0.5e0 - p) * pi()))) / pi(), 6) AS cauchy, least(1, round(count(p) * min(p), 6)) AS bonferroni,
round((1 + sum(CASE WHEN null_effect <= 20 THEN 1 ELSE 0 END)) / (1 + count(null_effect)), 9) AS permutation FROM {'p'} GROUP BY region""")
def combined_p(s, d):
    """P-values combined by region."""
    p = table(s, d, "events").selectExpr("user_id % 8 AS region", "(1 + event_id % 97) / 1e2 AS p", "value AS null_effect", "20e0 AS seen")
    return p.groupBy("region").agg(F.round(I.cauchy("p"), 6).alias("cauchy"), F.round(I.bonferroni_min("p"), 6).alias("bonferroni"), F.round(I.permutation_p("seen", "null_effect"), 9).alias("permutation"))


@query(f"""WITH {PREDICTIONS}, f AS (SELECT regime, y, mu AS x FROM predictions), k AS (SELECT DISTINCT regime AS held FROM f),
m AS (SELECT held, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS c FROM k, f WHERE regime <> held GROUP BY held)
SELECT regime, arm, count(*) AS n, round(sqrt(avg(CASE arm WHEN 'base' THEN (y - c) * (y - c) ELSE (y - a - b * x) * (y - a - b * x) END)), 4) AS rmse
FROM f JOIN m ON regime = held, (VALUES ('base'), ('text')) AS t(arm) GROUP BY regime, arm""")
def transfer_harness(s, d):
    """Leave-one-regime-out least squares over a ladder of features."""
    e = I.transfer_errors(predictions(s, d), "regime", {"base": [], "text": ["mu"]}, "y")
    return e.withColumn("rmse", F.round("rmse", 4))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def embedding_norms(s, d):
    """M10."""
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 6).alias("norm"))


@query(None)
def embedding_axes(s, d):
    """Eight principal components of each vector, fitted on even ids as the training fold (tested against numpy)."""
    e = table(s, d, "embeddings")
    mean, axes = I.principal_axes(e.where("vec_id % 2 = 0"), "embedding", 8)
    return e.select("vec_id", F.transform(I.project("embedding", mean, axes), lambda x: F.round(x, 4)).alias("parts"))


@query(None)
def propensity(s, d):
    """Inverse-propensity weights by logistic regression (tested by their properties)."""
    o = table(s, d, "orders").selectExpr("o_orderkey", "o_orderstatus = 'F' AS flag", "o_totalprice / 1e5 AS price", "CAST(o_custkey % 10 AS DOUBLE) AS c")
    return I.propensity_weights(o, "flag", ["price", "c"]).select("o_orderkey", F.round("weight", 4).alias("weight"))


@query(f"""WITH {POINTS} SELECT id, round(1 / (1 + exp(-greatest(-30, least(30, (v - 4000) / 800)))), 9) AS gate, round(exp(-0.5e0 * pow((lat - 35) / 2, 2)), 9) AS bell,
round(exp(ln(1 + greatest(v, 0))) - 1, 4) AS back, round(sin(lat * 0.25e0), 9) AS s0, round(cos(lat * 0.25e0), 9) AS c0, round(sin(lat * 0.5e0), 9) AS s1, round(cos(lat * 0.5e0), 9) AS c1 FROM points""")
def gate_values(s, d):
    """M7: sigmoid and Gaussian gates, the target transform there and back, Fourier features."""
    f = gates.fourier(F.col("lat"), 2, -2)
    back = gates.from_log(gates.to_log(F.col("v")))
    return points(s, d).select("id", F.round(gates.sigmoid(F.col("v"), 4000.0, 800.0), 9).alias("gate"), F.round(gates.bell(F.col("lat"), 35.0, 2.0), 9).alias("bell"), F.round(back, 4).alias("back"), *[F.round(x, 9).alias(n) for x, n in zip(f, ("s0", "c0", "s1", "c1"))])


_NEAR = """m AS (SELECT avg(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))) AS mean FROM points a JOIN points b ON a.id < b.id)"""


def _flat(s, d):
    return points(s, d).selectExpr("id", "lon AS x", "lat AS y", "code")


@query(f"""WITH {POINTS}, {_NEAR}, q AS (SELECT a.id, min(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))) AS dist FROM points a JOIN points b ON a.code <> b.code GROUP BY a.id)
SELECT id, round(dist, 6) AS distance, round(dist / mean, 6) AS dissimilarity FROM q, m""")
def dissimilarity_index(s, d):
    """M9: the distance to the nearest point of another group, over the mean distance of all pairs."""
    q = spatial.dissimilarity(_flat(s, d), _flat(s, d), "id", 0.2, mode="groups", group="code")
    return q.select("id", F.round("distance", 6).alias("distance"), F.round("dissimilarity", 6).alias("dissimilarity"))


@query(f"""WITH {POINTS}, {_NEAR}, q AS (SELECT a.id, min(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))) AS dist FROM points a JOIN points b ON a.id <> b.id GROUP BY a.id)
SELECT id, round(dist / mean, 6) AS dissimilarity FROM q, m""")
def dissimilarity_leave_one_out(s, d):
    """M9: the same to the nearest other point."""
    return spatial.dissimilarity(_flat(s, d), _flat(s, d), "id", 0.2, mode="others").select("id", F.round("dissimilarity", 6).alias("dissimilarity"))


@query(f"""WITH {PREDICTIONS} SELECT row_id, round(exp(mu / 100 + sd * sd / 20000) - 1, 6) AS mean, round(exp(mu / 100) - 1, 6) AS median, round(exp(mu / 100 + sd * sd / 20000) * sqrt(exp(sd * sd / 10000) - 1), 6) AS deviation,
round(1 / (1 + exp(-greatest(-30, least(30, (mu - 120) / 8)))), 9) AS band0, round(1 / (1 + exp(-greatest(-30, least(30, (mu - 150) / 4)))), 9) AS band1 FROM predictions""")
def log_moments(s, d):
    """M5, M6: moments of a log-normal back on the scale of y, and banded gates."""
    mu, sd = F.col("mu") / 100, F.col("sd") / 100
    (mean, dev), (median, _) = gates.log_moments(mu, sd), gates.log_moments(mu, sd, median=True)
    b = gates.banded(F.col("mu"), [(120.0, 8.0), (150.0, 4.0)])
    return predictions(s, d).select("row_id", F.round(mean, 6).alias("mean"), F.round(median, 6).alias("median"), F.round(dev, 6).alias("deviation"), F.round(b[0], 9).alias("band0"), F.round(b[1], 9).alias("band1"))


@query(f"""WITH {PREDICTIONS}, u AS (SELECT regime, avg(abs(y - mu)) < avg(abs(y - 150)) AS won, avg(abs(y - mu)) - avg(abs(y - 150)) AS diff FROM predictions GROUP BY regime), k AS (SELECT count(*) FILTER (WHERE won) AS wins, count(*) AS n FROM u)
SELECT wins, n, round((SELECT sum(c) FROM (SELECT factorial(CAST(n AS INT)) / (factorial(CAST(i AS INT)) * factorial(CAST(n - i AS INT))) AS c FROM range(0, 30) r(i) WHERE i >= wins AND i <= n)) / pow(2, n), 9) AS sign_p FROM k""")
def sign_test(s, d):
    """One-sided sign test over regimes; the regimes' means come from Spark, the sum of combinations is arithmetic."""
    u = predictions(s, d).groupBy("regime").agg((F.avg(F.abs(F.col("y") - F.col("mu"))) < F.avg(F.abs(F.col("y") - 150))).alias("won"))
    wins, n = u.agg(F.sum(F.col("won").cast("bigint")), F.count("*")).first()
    return s.createDataFrame([(wins, n, round(I.sign_test(wins, n), 9))], "wins bigint, n bigint, sign_p double")


@query(None)
def unit_mean_interval(s, d):
    """Percentile bootstrap of regimes' mean differences, the signed-rank test and Stouffer's combination over them (seeded; tested alone)."""
    u = predictions(s, d).groupBy("regime").agg(F.avg(F.abs(F.col("y") - F.col("mu")) - F.abs(F.col("y") - 150)).alias("diff"), F.avg((F.col("y") > F.col("mu")).cast("double")).alias("p")).orderBy("regime").collect()
    low, high = I.percentile_interval([r["diff"] for r in u])
    return s.createDataFrame([(float(low), float(high), I.wilcoxon([r["diff"] for r in u]), I.stouffer([r["p"] for r in u]))], "low double, high double, wilcoxon double, stouffer double")


@query(None)
def boosted_transfer(s, d):
    """Leave-one-regime-out errors of boosted trees and of a forest with its trees' spread (fitted; tested by their errors)."""
    p = predictions(s, d).withColumns({"a": F.col("unit") % 7, "b": F.col("row_id") % 11})
    boosted = I.tree_errors(p, "regime", ["mu", "sd", "a", "b"], "y", trees=5, depth=3).withColumns({"learner": F.lit("boosted"), "spread": F.lit(None).cast("double")})
    forest = I.tree_errors(p, "regime", ["mu", "sd", "a", "b"], "y", learner="forest", trees=5, depth=3).withColumn("learner", F.lit("forest"))
    return boosted.unionByName(forest)
