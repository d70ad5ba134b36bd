"""Queries over audits, distances between distributions, histograms and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corelog.operators import aggregates as A
from corelog.operators.quantiles import percentiles
from corelog.queries.inputs import PREDICTIONS, PROFILE, predictions, profile
from corelog.registry import query, table

_LINES = "l AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus FROM lineitem)"


@query("""WITH e AS (SELECT l_orderkey, l_suppkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL), k AS (SELECT l_suppkey, l_linenumber, count(*) AS k, sum(c) AS c FROM e GROUP BY ALL)
SELECT count(*) AS n_keys, CAST(sum(k) AS BIGINT) AS n_entities, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_keys, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS entities_in_multi,
max(k) AS max_entities, CAST(sum(CASE WHEN k > 1 THEN c ELSE 0 END) AS BIGINT) AS rows_in_multi, CAST(sum(c) AS BIGINT) AS n_rows FROM k""")
def key_collisions(s, d):
    """A3, A2: how many orders share a (supplier, line number) key."""
    return A.key_collisions(table(s, d, "lineitem"), "l_orderkey", ["l_suppkey", "l_linenumber"])


@query("""WITH k AS (SELECT l_partkey, l_linenumber, count(DISTINCT l_orderkey) AS k, count(DISTINCT l_returnflag) AS p FROM lineitem GROUP BY ALL)
SELECT count(*) AS multi_keys, round(avg(CASE WHEN p > 1 THEN 1 ELSE 0 END), 9) AS mix_rate FROM k WHERE k > 1""")
def collision_mix(s, d):
    """A4."""
    return A.collision_mix(table(s, d, "lineitem"), "l_orderkey", ["l_partkey", "l_linenumber"], "l_returnflag")


@query("""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, count(*) AS n, round(avg(o_totalprice), 9) AS mean_price, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY o_custkey""")
def group_first_size(s, d):
    """First by key, size, mean and distinct count of each group, in one shuffle."""
    g = table(s, d, "orders").groupBy("o_custkey")
    return g.agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 9).alias("mean_price"), F.count_distinct("o_orderstatus").alias("n_status"))


_FLAG = "f AS (SELECT l_returnflag = 'R' AS r, l_quantity AS q, l_extendedprice AS e, l_linestatus || l_linenumber AS c FROM lineitem)"


def _flagged(s, d):
    return table(s, d, "lineitem").selectExpr("l_returnflag = 'R' AS r", "l_quantity AS q", "l_extendedprice AS e", "concat(l_linestatus, l_linenumber) AS c")


@query(f"""WITH {_FLAG} SELECT round((avg(q) FILTER (WHERE r) - avg(q) FILTER (WHERE NOT r)) / sqrt((var_pop(q) FILTER (WHERE r) + var_pop(q) FILTER (WHERE NOT r)) / 2), 6) AS smd_q,
round((avg(e) FILTER (WHERE r) - avg(e) FILTER (WHERE NOT r)) / sqrt((var_pop(e) FILTER (WHERE r) + var_pop(e) FILTER (WHERE NOT r)) / 2), 6) AS smd_e FROM f""")
def mean_differences(s, d):
    """A20."""
    return A.smd(_flagged(s, d), "r", ["q", "e"]).select(F.round("smd_q", 6).alias("smd_q"), F.round("smd_e", 6).alias("smd_e"))


@query(f"""WITH {_FLAG}, k AS (SELECT c, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE NOT r) AS b FROM f GROUP BY c)
SELECT round(0.5e0 * sum(abs(a / (SELECT sum(a) FROM k) - b / (SELECT sum(b) FROM k))), 9) AS tv FROM k""")
def category_distance(s, d):
    """Total variation between two categories' shares."""
    return A.total_variation(_flagged(s, d), "r", "c").select(F.round("tv", 9).alias("tv"))


@query("""SELECT l_returnflag, round(sum(l_quantity) * sum(l_quantity) / (count(*) * sum(l_quantity * l_quantity)), 9) AS fraction FROM lineitem GROUP BY l_returnflag""")
def effective_sample(s, d):
    """A22."""
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(A.effective_fraction("l_quantity"), 9).alias("fraction"))


@query("""SELECT CAST(least(floor((greatest(0, least(10000, c_acctbal)) - 0) / 500e0), 19) AS INT) AS bin, count(*) AS n FROM customer GROUP BY 1""")
def value_histogram(s, d):
    """A29."""
    return A.histogram(table(s, d, "customer"), "c_acctbal", 0.0, 10000.0, 20)


@query(f"""WITH {PREDICTIONS}, e AS (SELECT min(mu) AS lo, quantile_cont(mu, 0.99) AS hi FROM predictions),
b AS (SELECT CAST(least(floor((mu - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, mu, abs(y - mu) AS r FROM predictions, e WHERE mu <= hi)
SELECT bin, count(*) AS n, round(avg(mu), 6) AS mean_sd, round(avg(r), 6) AS mean_abs FROM b GROUP BY bin""")
def binned_residuals(s, d):
    """Absolute residuals by bins up to the 99th percentile."""
    p = predictions(s, d).withColumn("r", F.col("y") - F.col("mu"))
    return A.binned_calibration(p, "mu", "r").select("bin", "n", F.round("mean_sd", 6).alias("mean_sd"), F.round("mean_abs", 6).alias("mean_abs"))


@query(f"""WITH {PROFILE}, b AS (SELECT CASE WHEN depth >= 0 AND depth < 5 THEN 0 WHEN depth >= 5 AND depth < 10 THEN 1 WHEN depth >= 10 AND depth < 20 THEN 2 WHEN depth >= 20 AND depth < 40 THEN 3 END AS bin, n - 25 AS e FROM profile)
SELECT bin, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 50""")
def rmse_by_depth(s, d):
    """A31, F12."""
    p = profile(s, d).withColumn("e", F.col("n") - 25)
    return A.binned_rmse(p, "depth", "e", [0, 5, 10, 20, 40]).withColumn("rmse", F.round("rmse", 6))


@query("""SELECT quantile_cont(c_acctbal, 0.02) AS low, quantile_cont(c_acctbal, 0.98) AS high, round(quantile_cont(c_acctbal, 0.75) + 1.5e0 * (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)), 6) AS threshold,
round((quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / 2, 6) AS softness FROM customer""")
def quantile_limits(s, d):
    """A33, A34."""
    q = percentiles(table(s, d, "customer"), [], "c_acctbal", {"low": 0.02, "high": 0.98, "q1": 0.25, "q3": 0.75})
    return q.select("low", "high", F.round(F.expr("q3 + 1.5D * (q3 - q1)"), 6).alias("threshold"), F.round(F.expr("(q3 - q1) / 2"), 6).alias("softness"))


@query("""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT round(avg(list_distance(a.v, b.v)), 6) AS mean_distance FROM x a, x b WHERE a.vec_id < b.vec_id""")
def mean_pairwise_distance(s, d):
    """Over all pairs of embeddings; pairs are blocked and computed by matrix products."""
    return A.mean_pairwise_distance(table(s, d, "embeddings"), "vec_id", "embedding").select(F.round("mean_distance", 6).alias("mean_distance"))


@query(f"""WITH {PREDICTIONS} SELECT regime, count(*) AS n, round(avg(y - mu), 6) AS bias, round(greatest(0.5, least(2.0, stddev_samp(y - mu) / avg(sd))), 6) AS scale FROM predictions GROUP BY regime HAVING count(*) >= 30""")
def regime_bias_scale(s, d):
    """A36."""
    g = A.group_calibration(predictions(s, d), "regime", "y", "mu", "sd")
    return g.select("regime", "n", F.round("bias", 6).alias("bias"), F.round("scale", 6).alias("scale"))


@query("""SELECT count(*) / count(*) AS share_doc_id, count(lang) / count(*) AS share_lang, count(nullif(text, '')) / count(*) AS share_text FROM documents""")
def column_coverage(s, d):
    """A37."""
    return A.non_null_shares(table(s, d, "documents").selectExpr("doc_id", "lang", "nullif(text, '') AS text"), ["doc_id", "lang", "text"])


@query("SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_shares(s, d):
    """A38."""
    return A.value_shares(table(s, d, "documents"), "lang")


@query("""WITH g AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_entities, count(*) AS n_rows FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT * FROM g WHERE n_rows >= 300""")
def top_labels(s, d):
    """The ten labels of most entities (a top-k report), then a floor of rows."""
    return A.top_labels(table(s, d, "lineitem"), "l_suppkey", "l_orderkey", 10, 300)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round((o_totalprice - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER ()) / stddev_pop(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (), 6) END AS z FROM orders""")
def masked_z_scores(s, d):
    """Standardised by the observed rows' mean and deviation."""
    o = table(s, d, "orders").withColumn("m", F.col("o_orderstatus") == "F")
    return A.masked_standardise(o, "o_totalprice", "m", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY mu) + (count(*) OVER (PARTITION BY mu) - 1) / 2 AS rm FROM predictions)
SELECT round(corr(ry, rm), 9) AS rho FROM r""")
def spearman_rank(s, d):
    """Rank correlation with average ranks of ties."""
    return A.spearman(predictions(s, d), "y", "mu").select(F.round("rho", 9).alias("rho"))


@query(f"""WITH {PREDICTIONS}, z AS (SELECT (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS a, (mu - avg(mu) OVER ()) / stddev_pop(mu) OVER () AS b FROM predictions) SELECT round(sqrt(avg((a - b) * (a - b))), 6) AS z_rmse FROM z""")
def z_scored_rmse(s, d):
    """RMSE of both columns in units of their own deviation."""
    return A.z_scored_rmse(predictions(s, d), "y", "mu").select(F.round("z_rmse", 6).alias("z_rmse"))


@query(f"""WITH {PREDICTIONS}, q AS (SELECT regime, quantile_cont(abs(y - mu), 0.25) AS q1, quantile_cont(abs(y - mu), 0.75) AS q3 FROM predictions GROUP BY 1)
SELECT regime, round(q3 + 1.5e0 * (q3 - q1), 6) AS threshold, round((q3 - q1) / 2, 6) AS softness FROM q""")
def gate_parameters(s, d):
    """A gate's threshold and softness by regime."""
    g = A.gate_parameters(predictions(s, d).withColumn("r", F.abs(F.col("y") - F.col("mu"))), "r", ["regime"])
    return g.select("regime", F.round("threshold", 6).alias("threshold"), F.round("softness", 6).alias("softness"))


@query(f"""WITH {PREDICTIONS} SELECT regime, count(*) AS n, round(quantile_cont(y - mu, 0.25), 6) AS q25, round(quantile_cont(y - mu, 0.5), 6) AS q50, round(quantile_cont(y - mu, 0.75), 6) AS q75 FROM predictions GROUP BY regime HAVING count(*) >= 30""")
def residual_boxes(s, d):
    """R7."""
    b = A.box_summary(predictions(s, d).withColumn("r", F.col("y") - F.col("mu")), "regime", "r")
    return b.select("regime", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


@query(f"""WITH {PREDICTIONS}, f AS (SELECT unit % 5 AS fold, sqrt(avg((y - mu) * (y - mu))) AS rmse, avg(CASE WHEN abs(y - mu) <= 2 * sd THEN 1 ELSE 0 END) AS cov FROM predictions GROUP BY 1)
SELECT round(avg(rmse), 6) AS mean_rmse, round(avg(cov), 6) AS mean_cover, avg(rmse) <= 120 AND abs(avg(cov) - 0.95e0) <= 0.1e0 AS passed FROM f""")
def gate_verdict(s, d):
    """Mean RMSE and coverage of the folds against their tolerances."""
    p = predictions(s, d)
    e = F.col("y") - F.col("mu")
    f = p.groupBy((F.col("unit") % 5).alias("fold")).agg(F.sqrt(F.avg(e * e)).alias("rmse"), A.share(F.abs(e) <= 2 * F.col("sd")).alias("cov"))
    return f.agg(F.round(F.avg("rmse"), 6).alias("mean_rmse"), F.round(F.avg("cov"), 6).alias("mean_cover"), ((F.avg("rmse") <= 120) & (F.abs(F.avg("cov") - 0.95) <= 0.1)).alias("passed"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_max,
round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running_sum FROM events""")
def ordered_windows(s, d):
    """Place, group size, running maximum and sum, of one sort."""
    g = Window.partitionBy("user_id")
    w = g.orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "events").select("event_id", F.count("*").over(g).alias("n"), F.row_number().over(w).alias("place"), F.round(F.max("value").over(run), 6).alias("running_max"), F.round(F.sum("value").over(run), 4).alias("running_sum"))
