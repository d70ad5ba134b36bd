"""Aggregates: audits, metrics, histograms, distances between distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.operators.common import kept, ratio
from corelog.operators.quantiles import percentiles


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds; NULL counts as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def key_collisions(df: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """One row: how many entities share a (rounded) key. Two aggregations: entities, then keys."""
    entities = df.groupBy(entity, *keys).agg(F.count("*").alias("rows_"))
    per_key = entities.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("rows_").alias("rows_"))
    multi = F.col("k") > 1
    return per_key.agg(
        F.count("*").alias("n_keys"), F.sum("k").alias("n_entities"), F.sum(multi.cast("bigint")).alias("multi_keys"),
        F.sum(F.when(multi, F.col("k")).otherwise(0)).alias("entities_in_multi"), F.max("k").alias("max_entities"),
        F.sum(F.when(multi, F.col("rows_")).otherwise(0)).alias("rows_in_multi"), F.sum("rows_").alias("n_rows"),
    )


def collision_mix(df: DataFrame, entity: str, keys: list[str], provenance: str) -> DataFrame:
    """One row: of keys with several entities, the share with more than one provenance value (NULL doesn't count as one)."""
    k = df.groupBy(*keys).agg(F.count_distinct(entity).alias("k"), F.count_distinct(provenance).alias("p")).where("k > 1")
    return k.agg(F.count("*").alias("multi_keys"), F.round(share(F.col("p") > 1), 9).alias("mix_rate"))


def regime_metrics(df: DataFrame, regime: str, y: str, mu: str, sd: str) -> DataFrame:
    """Per regime: n, RMSE, MAE, R2 against the variance of all rows, mean Gaussian log-likelihood, variance of z.

    The variance of all rows joins as one row; NULL or NaN rows are left out first, and those of no spread have no z.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(mu).isNotNull() & F.col(sd).isNotNull() & ~F.isnan(y) & ~F.isnan(mu) & ~F.isnan(sd))
    whole = ok.agg(F.var_pop(y).alias("_var"))
    e = F.col(y) - F.col(mu)
    z = e / F.nullif(F.col(sd), F.lit(0.0))
    ll = -0.5 * (F.log(F.lit(6.283185307179586)) + 2 * F.log(F.nullif(F.col(sd), F.lit(0.0))) + z * z)
    g = ok.groupBy(regime).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("_mse"), F.avg(ll).alias("log_lik"), F.var_pop(z).alias("z_var"))
    return g.crossJoin(F.broadcast(whole)).select(regime, "n", "rmse", "mae", (1 - F.col("_mse") / F.nullif(F.col("_var"), F.lit(0.0))).alias("r2"), "log_lik", "z_var")


def smd(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """One row: standardised mean difference of each column between flagged and other rows, with population variances. NULL
    where neither varies, or a side is empty."""
    out = []
    for c in columns:
        a, b = F.when(F.col(flag), F.col(c)), F.when(~F.col(flag), F.col(c))
        out.append(ratio(F.avg(a) - F.avg(b), F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)).alias(f"smd_{c}"))
    return df.agg(*out)


def total_variation(df: DataFrame, flag: str, category: str) -> DataFrame:
    """One row: half the summed difference of the category's shares among flagged and other rows; NULL is no category. NULL if a
    side is empty."""
    k = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum(F.col(flag).cast("bigint")).alias("a"), F.sum((~F.col(flag)).cast("bigint")).alias("b"))
    whole = k.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return k.crossJoin(F.broadcast(whole)).agg((0.5 * F.sum(F.abs(ratio(F.col("a"), F.col("ta")) - ratio(F.col("b"), F.col("tb"))))).alias("tv"))


def effective_fraction(w: str) -> Column:
    """(sum w)^2 / (n sum w^2); NULL where all weights are 0."""
    return ratio(F.sum(w) * F.sum(w), F.count(w) * F.sum(F.col(w) * F.col(w)))


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of values clipped to [low, high]; the last bin holds its upper edge. Empty bins are left out."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col(c).cast("double")))
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def binned_calibration(df: DataFrame, sd: str, residual: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_sd, mean_abs): absolute residuals by predicted spread, in equal bins from the least to the 99th percentile.
    A constant spread is one bin, 0."""
    edge = df.agg(F.min(sd).alias("_lo")).crossJoin(F.broadcast(percentiles(df, [], sd, {"_hi": 0.99}).select("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.coalesce(F.floor(ratio(F.col(sd) - F.col("_lo"), width)), F.lit(0))
    b = F.when(F.col(sd) <= F.col("_hi"), F.least(place, F.lit(bins - 1)).cast("int"))
    d = df.crossJoin(F.broadcast(edge)).withColumn("bin", b).where("bin IS NOT NULL")
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.avg(sd).alias("mean_sd"), F.avg(F.abs(residual)).alias("mean_abs"))


def binned_rmse(df: DataFrame, position: str, error: str, edges: list[float], least: int = 50) -> DataFrame:
    """(bin, n, rmse) by half-open bins [edge, next edge); bins of fewer than `least` rows are dropped."""
    case = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        case = F.when((F.col(position) >= edges[i]) & (F.col(position) < edges[i + 1]), i).otherwise(case)
    g = df.withColumn("bin", case).where("bin IS NOT NULL").groupBy("bin")
    return g.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse")).where(F.col("n") >= least)


def z_diagnostics(df: DataFrame, z: str, by: list[str] | None = None) -> DataFrame:
    """(by, mean_z2, kurtosis, median, q95_abs): mean of z^2, kurtosis (3 for a normal), median, 95th percentile of |z|."""
    by, c = by or [], F.col(z)
    d = df.select(*by, z, F.abs(c).alias("_abs"))
    out = d.groupBy(*by).agg(F.avg(c * c).alias("mean_z2"), (F.kurtosis(c) + 3).alias("kurtosis"))
    for name, column, share_ in (("median", z, 0.5), ("q95_abs", "_abs", 0.95)):
        q = percentiles(d, by, column, {name: share_}).drop("n")
        out = out.join(q, by, "left") if by else out.crossJoin(F.broadcast(q))
    return out


def gate_parameters(df: DataFrame, d: str, by: list[str] | None = None) -> DataFrame:
    """(by, threshold, softness): Q3 + 1.5 IQR and IQR / 2."""
    spread = F.col("_q3") - F.col("_q1")
    return percentiles(df, by or [], d, {"_q1": 0.25, "_q3": 0.75}).select(*(by or []), (F.col("_q3") + 1.5 * spread).alias("threshold"), (spread / 2).alias("softness"))


def top_labels(df: DataFrame, label: str, entity: str, top: int, floor: int) -> DataFrame:
    """(label, n_entities, n_rows) of the `top` labels by distinct entities (ties by name), then those with `floor` rows."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count_distinct(entity).alias("n_entities"), F.count("*").alias("n_rows"))
    return g.orderBy(F.desc("n_entities"), label).limit(top).where(F.col("n_rows") >= floor)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation with average ranks of ties."""
    return average_rank(average_rank(df, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("rho"))


def z_scored_rmse(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: RMSE between both columns, each centred and scaled by its own population deviation (from one aggregation).

    With means of x, y, xx, yy and xy that is sqrt(2 - 2 corr). NULL where either is constant.
    """
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return ok.agg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * r)).alias("z_rmse"), r.alias("_r")).select(F.when(F.col("_r").isNotNull(), F.col("z_rmse")).alias("z_rmse"))


def average_rank(df: DataFrame, c: str, name: str, bins: int = 512) -> DataFrame:
    """df with the 1-based rank of c over all rows, the mean of places where values tie. Rows with NULL or NaN there go.

    No window holds all rows: distinct values are counted, cut in about equally full ranges by a quantile sketch (its
    `bins` edges reach the driver) and ranked inside their range; what stands in lower ranges comes from the ranges' totals.
    """
    from pyspark.ml.feature import Bucketizer

    ok = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    counts = ok.groupBy(c).agg(F.count("*").alias("_n")).withColumn("_x", F.col(c).cast("double"))
    edges = counts.agg(F.percentile_approx("_x", F.array(*[F.lit((i + 1) / (bins + 1)) for i in range(bins)]))).first()[0] or [0.0]
    splits = [float("-inf"), *sorted({e for e in edges if abs(e) < float("inf")} or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(counts)
    total = ranged.groupBy("_b").agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = total.select("_b", before.alias("_base"))
    inside = F.sum("_n").over(Window.partitionBy("_b").orderBy("_x")) - F.col("_n")
    ranks = ranged.withColumn("_in", inside).join(F.broadcast(base), "_b").select(c, (F.col("_base") + F.col("_in") + (F.col("_n") + 1) / 2).alias(name))
    return ok.join(ranks, c)


def group_calibration(df: DataFrame, regime: str, y: str, mu: str, sd: str, least: int = 30, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(regime, bias, scale): mean residual, and sample deviation of residuals over mean spread clamped to [low, high]; (0, 1) under `least` rows,
    scale 1 where the mean spread is 0."""
    e = F.col(y) - F.col(mu)
    g = df.groupBy(regime).agg(F.count("*").alias("n"), F.avg(e).alias("b"), F.stddev_samp(e).alias("s"), F.avg(sd).alias("m"))
    ok = F.col("n") >= least
    return g.select(regime, "n", F.when(ok, F.col("b")).otherwise(0.0).alias("bias"), F.when(ok, F.coalesce(F.when(F.col("m") != 0, F.greatest(F.lit(low), F.least(F.lit(high), ratio(F.col("s"), F.col("m"))))), F.lit(1.0))).otherwise(1.0).alias("scale"))


def non_null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of rows of each column that aren't NULL."""
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(f"share_{c}") for c in columns])


def value_shares(df: DataFrame, c: str) -> DataFrame:
    """(c, n, share) of values that aren't NULL."""
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def masked_standardise(df: DataFrame, c: str, mask: str, name: str, floor: float = 1e-8) -> DataFrame:
    """df with (c - mean) / deviation, both of the rows where mask holds only, NULL elsewhere. A deviation under `floor` counts
    as 1: a constant column gives 0."""
    v = F.when(F.col(mask), F.col(c))
    s = df.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, F.when(F.col(mask), (F.col(c) - F.col("_m")) / F.when(F.col("_s") < floor, 1.0).otherwise(F.col("_s")))).drop("_m", "_s")


def box_summary(df: DataFrame, group: str, c: str, least: int = 30) -> DataFrame:
    """(group, n, q25, q50, q75) of groups with at least `least` rows."""
    return percentiles(df, [group], c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).where(F.col("n") >= least)


def mean_pairwise_distance(df: DataFrame, key: str, vector: str, blocks: int = 16) -> DataFrame:
    """One row: the mean Euclidean distance of all unordered pairs of rows, NULL without pairs. Rows without a vector don't count.

    Equal vectors are one with their number, which leaves the sum as it is. Between different ones the work is quadratic by
    definition, memory isn't: they are hashed into `blocks`, more if a block would hold over 20,000, each pair of blocks is
    one task that takes matrix products in slices and returns a sum, so that no pairs are shuffled.
    """
    d = df.where(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("_v")).agg(F.count("*").cast("double").alias("_n"))
    d = kept(d, "vectors")
    different, rows = d.agg(F.count("*"), F.sum("_n")).first()
    blocks = max(blocks, -(-different // 20_000))
    d = d.withColumn("_b", F.pmod(F.xxhash64("_v"), F.lit(blocks)))
    ids = F.sequence(F.lit(0), F.lit(blocks - 1))
    sent = d.withColumn("_o", F.explode(ids)).select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), F.col("_b") == F.least("_b", "_o"), "_v", "_n").toDF("_i", "_j", "_first", "_v", "_n")

    def total(f: pd.DataFrame) -> pd.DataFrame:
        same = f["_i"].iloc[0] == f["_j"].iloc[0]
        first, second = (f, f) if same else (f[f["_first"]], f[~f["_first"]])
        if not len(first) or not len(second):
            return pd.DataFrame({"s": [0.0]})
        a, c = np.array(first["_v"].tolist(), float), np.array(second["_v"].tolist(), float)
        m, n = first["_n"].to_numpy(float), second["_n"].to_numpy(float)
        few = a.shape[1] <= 4
        if not few:
            # The products of centred vectors lose fewer digits.
            centre = a.mean(0)
            a, c = a - centre, c - centre
            aa, cc = (a * a).sum(1), (c * c).sum(1)
        s, step = 0.0, max(1, 2_000_000 // len(c))
        for i in range(0, len(a), step):
            x = a[i : i + step]
            d2 = sum((x[:, [k]] - c[:, k]) ** 2 for k in range(a.shape[1])) if few else aa[i : i + step, None] + cc - 2 * (x @ c.T)
            if same and not few:
                d2[np.arange(len(x)), np.arange(i, i + len(x))] = 0.0
            s += float(m[i : i + step] @ (np.sqrt(np.maximum(d2, 0.0)) @ n))
        return pd.DataFrame({"s": [s / 2 if same else s]})

    pairs = (rows or 0.0) * ((rows or 0.0) - 1) / 2
    return sent.groupBy("_i", "_j").applyInPandas(total, "s double").agg((F.sum("s") / F.nullif(F.lit(pairs), F.lit(0.0))).alias("mean_distance"))
