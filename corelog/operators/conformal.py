"""Calibration of predictions: exact conformal quantiles, per group and weighted, and their reports."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.operators.common import bounded, kept
from corelog.operators.quantiles import RANGES, order_statistics

#: local_quantiles() cuts either side into so many pieces at most.
PIECES = 64


def coverage(y: str, mu: str, sd: str, alpha: float) -> Column:
    """Share of y inside mu +- z sd of a normal distribution's central interval."""
    z = NormalDist().inv_cdf(0.5 + alpha / 2)
    return F.avg((F.abs(F.col(y) - F.col(mu)) <= z * F.col(sd)).cast("int"))


def reliability(df: DataFrame, y: str, mu: str, sd: str, alphas: list[float]) -> DataFrame:
    """(alpha, empirical): all levels in one scan."""
    one = df.agg(*[coverage(y, mu, sd, a).alias(f"a{i}") for i, a in enumerate(alphas)])
    rows = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"a{i}").alias("empirical")) for i, a in enumerate(alphas)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def temperature(y: str, mu: str, sd: str) -> Column:
    """sqrt of the mean squared z."""
    z = (F.col(y) - F.col(mu)) / F.nullif(F.col(sd), F.lit(0.0))
    return F.sqrt(F.avg(z * z))


def order_statistic(df: DataFrame, by: list[str], score: str, alpha: float, name: str = "q", *, count: str | None = None) -> DataFrame:
    """(by, n, name): the k-th least score of each group, k = ceil((n + 1) alpha) held in [1, n]; exact, see order_statistics."""
    return order_statistics(df, by, score, {name: lambda n: F.greatest(F.lit(1), F.least(n, F.ceil((n + 1) * alpha)))}, count=count)


def mondrian(cal: DataFrame, group: str, score: str, alpha: float, least: int = 30) -> tuple[DataFrame, float | None]:
    """(group, n, q) of groups with `least` scores or more, and the marginal quantile for all others."""
    counts = kept(cal.groupBy(group, score).agg(F.count("*").alias("_rows")), "scores")
    marginal = order_statistic(counts, [], score, alpha, count="_rows").first()
    return order_statistic(counts, [group], score, alpha, count="_rows").where(F.col("n") >= least), marginal.q if marginal else None


def mondrian_interval(test: DataFrame, quantiles: DataFrame, marginal: float | None, group: str, mu: str, sd: str) -> DataFrame:
    """test with low, high: mu +- q sd by the group's quantile, or the marginal one."""
    q = F.coalesce("q", F.lit(marginal).cast("double"))
    d = test.join(bounded(quantiles.select(group, "q")), group, "left")
    return d.withColumns({"low": F.col(mu) - q * F.col(sd), "high": F.col(mu) + q * F.col(sd)}).drop("q")


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, alpha: float, *, atom: float = 0.0, name: str = "q") -> DataFrame:
    """(by, name): the least value whose cumulative weight reaches alpha of the total.

    atom: weight of a further value at infinity; where alpha falls on it the result is infinite. Weights of 0 in all give
    the greatest value.
    """
    w = Window.partitionBy(*by)
    g = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    run = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumns({"_t": F.sum("_w").over(w) + atom, "_r": run})
    hit = F.when(F.col("_r") / F.nullif(F.col("_t"), F.lit(0.0)) >= alpha - 1e-12, F.col(value))
    none = F.when(F.max("_t") > 0, F.lit(float("inf"))) if atom else F.max(value)
    return g.groupBy(*by).agg(F.coalesce(F.min(hit), none, F.max(value)).alias(name))


def shifted_quantile(test: DataFrame, cal: DataFrame, key: str, by: list[str], score: str, weight: str, own: str, alpha: float) -> DataFrame:
    """(key, q): for each test row the weighted quantile of its group's calibration scores with the row's own weight at infinity.

    The place is alpha (total + own) in the running sum of weights; different places and running sums are stacked, and a
    window carries the next score back, so no test row meets every score. Both windows are over (group, range), so a group
    that holds most rows is many tasks' work: each range of scores begins with the sum of those before it, each range of
    places ends with the first score after it. Infinite where the place lies on the row's own weight. Groups without
    calibration rows give NULL.
    """
    shares = F.array(*[F.lit((i + 1) / RANGES) for i in range(RANGES - 1)])
    part = lambda x: F.size(F.filter("_e", lambda e: e < F.col(x))).alias("_part")

    def cut(df: DataFrame, x: str) -> DataFrame:
        edges = bounded(df.groupBy(*by).agg(F.percentile_approx(x, shares).alias("_e")), "edges")
        return df.join(edges, by).select(*df.columns, part(x))

    up = Window.partitionBy(*by, "_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    g = cut(kept(cal.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.sum(weight).alias("_w")), "scores"), "_s")
    ranges = g.groupBy(*by, "_part").agg(F.sum("_w").alias("_t"))
    total = bounded(ranges.groupBy(*by).agg(F.sum("_t").alias("_total")), "totals")
    start = bounded(ranges.select(*by, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_start")), "starts")
    g = g.withColumn("_run", F.sum("_w").over(up)).join(start, [*by, "_part"])
    scores = g.select(*by, (F.col("_start") + F.col("_run")).alias("_at"), "_s", F.lit(1).alias("_side"))
    asked = test.join(total, by, "left").select(*by, key, (alpha * (F.col("_total") + F.col(own)) - 1e-9).alias("_at"), "_total")
    places = asked.where("_at IS NOT NULL").select(*by, "_at").distinct().withColumns({"_s": F.lit(None).cast("double"), "_side": F.lit(0)})
    both = cut(kept(places.unionByName(scores), "places"), "_at")
    after = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*by, "_part").agg(F.min("_s").alias("_s")).withColumn("_s", F.last("_s", ignorenulls=True).over(after)).where("_s IS NOT NULL")
    both = both.unionByName(carried.withColumns({"_at": F.lit(float("inf")), "_side": F.lit(1)}))
    # The first score at or after the place: from above, scores stand before equal places, the least of equal runs last.
    down = Window.partitionBy(*by, "_part").orderBy(F.desc("_at"), F.desc("_side"), F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("q", F.last("_s", ignorenulls=True).over(down)).where("_side = 0").select(*by, "_at", "q")
    return asked.join(bounded(found, "found"), [*by, "_at"], "left").select(key, F.coalesce("q", F.when(F.col("_total").isNotNull(), float("inf"))).alias("q"))


def local_quantiles(test: DataFrame, cal: DataFrame, key: str, features: list[str], score: str, alpha: float, width: float, block: int = 4096) -> DataFrame:
    """(key, q): the weighted quantile for each test row, with Gaussian kernel weights over all calibration rows.

    Every different test row weighs every different calibration row, so work is quadratic in these by definition; memory and
    shuffle are not. Test rows with equal features are one, and calibration rows that are equal in score and features are one
    with their number. Calibration rows are cut by score into blocks, test rows by hash into chunks, of `block` rows each or
    more, as both are PIECES at most. A first pass gives each test row's weight in each block; that names the block in which
    alpha is reached, which a second pass searches. Where all weights vanish the greatest score counts. Rows with NULL scores
    or features don't count; without calibration rows q is NULL.
    """
    from pyspark.ml.feature import Bucketizer

    names = [f"_c{i}" for i in range(len(features))]
    c = cal.dropna(subset=[score, *features]).select(F.col(score).cast("double").alias("_s"), *[F.col(f).alias(x) for f, x in zip(features, names)])
    c = kept(c.groupBy("_s", *names).agg(F.count("*").cast("double").alias("_n")), "scores")
    rows = test.dropna(subset=features).select(key, *features)
    t = kept(rows.groupBy(*features).agg(F.min(key).alias(key)), "asked")
    n, worst = c.agg(F.count("*"), F.max("_s")).first()
    if not n:
        return rows.select(key, F.lit(None).cast("double").alias("q"))
    m, p = min(PIECES, math.ceil(n / block)), min(PIECES, math.ceil(max(t.count(), 1) / block))
    ends = c.agg(F.percentile_approx("_s", F.array(*[F.lit(i / m) for i in range(1, m)]))).first()[0] if m > 1 else []
    splits = [float("-inf"), *sorted(set(ends)), float("inf")]
    if len(splits) > 2:
        c = Bucketizer(splits=splits, inputCol="_s", outputCol="_f").transform(c).withColumn("_b", F.col("_f").cast("int")).drop("_f")
    else:
        c = c.withColumn("_b", F.lit(0))
    c = c.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    t = t.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(p)).cast("int"))
    h = 2 * width * width
    kind = dict(test.dtypes)[key]

    def running(left: pd.DataFrame, right: pd.DataFrame):
        right = right.sort_values("_s", kind="stable")
        y, s, number = right[names].to_numpy(float), right["_s"].to_numpy(float), right["_n"].to_numpy(float)
        step = max(1, min(256, 1_000_000 // max(len(s), 1)))
        for i in range(0, len(left), step):
            rows = left.iloc[i : i + step]
            x = rows[features].to_numpy(float)
            yield rows, s, np.cumsum(np.exp(-sum((x[:, [j]] - y[:, j]) ** 2 for j in range(len(features))) / h) * number, 1)

    def weigh(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [rows[[key, "_b"]].assign(_w=run[:, -1]) for rows, s, run in running(left, right) if len(s)]
        return pd.concat(parts) if parts else pd.DataFrame({key: [], "_b": [], "_w": []})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for rows, s, run in running(left, right):
            share = (rows["_before"].to_numpy()[:, None] + run) / rows["_total"].to_numpy()[:, None]
            at = np.minimum((share < alpha - 1e-12).sum(1), max(len(s) - 1, 0))
            parts.append(rows[[key]].assign(q=s[at]))
        return pd.concat(parts) if parts else pd.DataFrame({key: [], "q": []})

    by = ["_p", "_b"]
    c = c.withColumnsRenamed({"_p": "_q", "_b": "_k"})
    asked = t.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(len(splits) - 2))))
    weights = asked.groupBy(*by).cogroup(c.groupBy("_q", "_k")).applyInPandas(weigh, f"{key} {kind}, _b int, _w double")
    w = Window.partitionBy(key)
    run = F.sum("_w").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    placed = weights.withColumns({"_total": F.sum("_w").over(w), "_run": run})
    enough = F.col("_run") >= (alpha - 1e-12) * F.col("_total")
    first = placed.where((F.col("_total") > 0) & enough).groupBy(key, "_total").agg(F.min(F.struct("_b", (F.col("_run") - F.col("_w")).alias("_before"))).alias("_x"))
    wanted = t.join(first.select(key, "_total", "_x.*"), key)
    found = wanted.groupBy(*by).cogroup(c.groupBy("_q", "_k")).applyInPandas(search, f"{key} {kind}, q double")
    each = bounded(t.join(found, key, "left").select(*features, F.coalesce("q", F.lit(float(worst))).alias("q")), "found")
    return rows.join(each, features).select(key, "q")


def isotonic(cal: DataFrame, z: str, bins: int = 2001) -> tuple[np.ndarray, np.ndarray]:
    """Grid of nominal levels and their recalibrated ones: the empirical CDF of Phi(z), made monotone by pooling.

    Spark counts rows by level (one row a bin goes to the driver); pooling of adjacent violators runs on the bins.
    """
    x = [NormalDist().inv_cdf((i + 1) / bins) for i in range(bins - 1)]
    level = F.floor(F.least(F.greatest(F.expr(f"0.5 * (1 + {_erf(z)})"), F.lit(0.0)), F.lit(1.0)) * (bins - 1) + 0.5)
    rows = cal.where(F.col(z).isNotNull() & ~F.isnan(z)).groupBy(level.cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
    n = np.zeros(bins)
    for r in rows:
        n[r.b] += r.n
    grid = np.linspace(0, 1, bins)
    return grid, np.maximum.accumulate(pool(np.cumsum(n) / max(n.sum(), 1), np.ones(bins))) if len(x) else grid


def inverse_levels(grid: np.ndarray, level: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The least nominal level whose recalibrated one reaches each wanted level, linear between grid points; the ends hold."""
    rise = np.concatenate([[True], np.diff(level) > 0])
    return np.interp(wanted, level[rise], grid[rise])


def _erf(z: str) -> str:
    """erf(z / sqrt 2) by Abramowitz and Stegun's 7.1.26 as an SQL expression (error under 2e-7)."""
    a = f"abs({z}) / sqrt(2D)"
    t = f"(1D / (1D + 0.3275911D * {a}))"
    poly = f"((((1.061405429D * {t} - 1.453152027D) * {t} + 1.421413741D) * {t} - 0.284496736D) * {t} + 0.254829592D) * {t}"
    return f"(signum({z}) * (1D - {poly} * exp(-({a}) * ({a}))))"


def pool(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit of a rising sequence (pool adjacent violators)."""
    means: list[list[float]] = []
    for v, k in zip(y, w, strict=True):
        means.append([float(v), float(k), 1])
        while len(means) > 1 and means[-2][0] > means[-1][0]:
            b, a = means.pop(), means.pop()
            total = a[1] + b[1]
            means.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), m) for m, _, n in means]) if means else np.zeros(0)


def winkler(y: str, low: str, high: str, alpha: float) -> Column:
    """Mean interval score: the width, and 2 / (1 - alpha) times what y lies outside."""
    out = F.greatest(F.lit(0.0), F.col(low) - F.col(y)) + F.greatest(F.lit(0.0), F.col(y) - F.col(high))
    return F.avg(F.col(high) - F.col(low) + 2 / (1 - alpha) * out)
