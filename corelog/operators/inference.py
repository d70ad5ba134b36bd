"""Effects, permutation inference and learners over held-out folds."""

from __future__ import annotations

import math
import uuid
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelog.operators.common import kept
from corelog.plans.shared import shared_dir

_N = NormalDist()


def effect(treated: Column, null: Column) -> Column:
    """100 (treated - null) / null; NULL where null is 0."""
    return 100 * (treated - null) / F.nullif(null, F.lit(0).cast("double"))


def group_losses(df: DataFrame, groups: list[str], losses: list[str]) -> DataFrame:
    """(groups, n, sums of the squared losses): what block bootstraps need, one row a group."""
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in losses])


def pooled_effect(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Effect on RMSE of a against b from group sums."""
    return 100 * (math.sqrt(a.sum() / n.sum()) / math.sqrt(b.sum() / n.sum()) - 1)


#: Units are resampled in so many hashed parts, each in one task. The draws of all parts together are one draw of all units.
PARTS = 64


def _resampled(units: DataFrame, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x and y in each replicate of units (part, x, y), which draws as many units as there are, with replacement.

    The driver draws how many units of each part a replicate takes, the part's task draws which: a multinomial draw
    of all units, as exact as one in a single place. Two numbers a replicate and part come back.
    """
    sizes = dict(sorted((r[0], r[1]) for r in units.groupBy("part").count().collect()))
    total = sum(sizes.values())
    takes = np.random.default_rng(seed).multinomial(total, np.array(list(sizes.values())) / total, size=replicates)
    takes = units.sparkSession.sparkContext.broadcast(dict(zip(sizes, takes.T)))

    def draw(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = rows.sort_by([("x", "ascending"), ("y", "ascending")])
        x, y, take = np.asarray(rows["x"]), np.asarray(rows["y"]), takes.value[part]
        rng = np.random.default_rng([seed, part])
        out, step = np.zeros((2, replicates)), max(1, 1_000_000 // len(x))
        for i in range(0, replicates, step):
            some = take[i : i + step]
            at, owner = rng.integers(0, len(x), some.sum()), np.repeat(np.arange(len(some)), some)
            for k, v in enumerate((x, y)):
                out[k, i : i + step] = np.bincount(owner, v[at], len(some))
        return pa.table({"part": pa.array([part], pa.int64()), "x": pa.array([out[0].tolist()]), "y": pa.array([out[1].tolist()])})

    # A number of partitions that is asked for isn't coalesced: few bytes are much work here.
    spread = units.repartition(PARTS, "part").groupBy("part")
    drawn = sorted(spread.applyInArrow(draw, "part long, x array<double>, y array<double>").collect(), key=lambda r: r["part"])
    return sum(np.array(r["x"]) for r in drawn), sum(np.array(r["y"]) for r in drawn)


def bca_interval(losses: DataFrame, a: str, b: str, *, replicates: int = 10_000, level: float = 0.95, seed: int = 42, buckets: int = 4096) -> tuple[float, float, float]:
    """(estimate, low, high): bias-corrected accelerated bootstrap of whole groups, with the leave-one-out jackknife.

    losses: group_losses(). All groups are resampled one by one, in executors, whatever their number; the work grows with
    groups times replicates. The jackknife is two aggregations over the groups. buckets: without effect, for callers
    that name it.
    """
    spark = losses.sparkSession
    key = [c for c in losses.columns if c not in ("n", a, b)]
    path = f"{shared_dir(spark)}/units-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(*key), F.lit(PARTS)).alias("part")
    losses.select(part, "n", F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).write.parquet(path)
    units = spark.read.parquet(path)
    n, x, y = units.agg(F.sum("n"), F.sum("x"), F.sum("y")).first()
    est = pooled_effect(*np.array([[n], [x], [y]], float))
    above, below = _resampled(units.select("part", "x", "y"), replicates, seed)
    draws = 100 * (np.sqrt(above / below) - 1)
    # A sum less its only summand may be a little below 0.
    left = F.greatest(x - F.col("x"), F.lit(0.0)) / F.nullif(y - F.col("y"), F.lit(0.0))
    jack = units.select((100 * (F.sqrt(left) - 1)).alias("j"))
    dev = F.lit(jack.agg(F.avg("j")).first()[0]) - F.col("j")
    squares, cubes = (v or 0.0 for v in jack.agg(F.sum(dev * dev), F.sum(dev * dev * dev)).first())
    acc = cubes / (6 * squares**1.5 or 1)
    share = min(max((draws < est).mean(), 1 / replicates), 1 - 1 / replicates)
    z0 = _N.inv_cdf(share)

    def edge(p: float) -> float:
        z = z0 + _N.inv_cdf(p)
        return float(np.quantile(draws, _N.cdf(z0 + z / (1 - acc * z))))

    return est, edge((1 - level) / 2), edge((1 + level) / 2)


def percentile_interval(values: list[float], *, replicates: int = 10_000, level: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Percentile bootstrap of the mean of a few units."""
    v = np.asarray(values, float)
    means = v[np.random.default_rng(seed).integers(0, len(v), (replicates, len(v)))].mean(1)
    return float(np.quantile(means, (1 - level) / 2)), float(np.quantile(means, (1 + level) / 2))


def stouffer(p: list[float]) -> float:
    """Combined p of one-sided tests by the mean normal score."""
    return 1 - _N.cdf(sum(_N.inv_cdf(1 - min(max(x, 1e-15), 1 - 1e-15)) for x in p) / math.sqrt(len(p)))


def cauchy(p: str) -> Column:
    """Combined p by Cauchy's rule, as an aggregate."""
    return 0.5 - F.atan(F.avg(F.tan((0.5 - F.col(p)) * math.pi))) / math.pi


def bonferroni_min(p: str) -> Column:
    return F.least(F.lit(1.0), F.count(p) * F.min(p))


def permutation_p(observed: str, null: str) -> Column:
    """(1 + nulls as low as the observed effect) / (1 + nulls), as an aggregate over nulls."""
    return (1 + F.sum((F.col(null) <= F.col(observed)).cast("bigint"))) / (1 + F.count(null))


def sign_test(wins: int, n: int) -> float:
    """One-sided: chance of so many wins or more of n fair coins."""
    return sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n


def wilcoxon(d: list[float]) -> float:
    """One-sided exact p of the signed-rank test that differences are below 0; zeros are left out."""
    d = sorted((x for x in d if x), key=abs)
    ranks, i = [0.0] * len(d), 0
    while i < len(d):
        j = i
        while j < len(d) and abs(d[j]) == abs(d[i]):
            j += 1
        for m in range(i, j):
            ranks[m] = (i + j + 1) / 2
        i = j
    half = [round(2 * r) for r in ranks]
    seen = round(2 * sum(r for x, r in zip(d, ranks) if x > 0))
    ways = {0: 1}
    for r in half:
        nxt = dict(ways)
        for s, c in ways.items():
            nxt[s + r] = nxt.get(s + r, 0) + c
        ways = nxt
    return sum(c for s, c in ways.items() if s <= seen) / 2 ** len(d)


def least_squares(train: DataFrame, features: list[str], y: str, by: list[str] | None = None, ridge: float = 1e-9) -> dict[tuple, np.ndarray]:
    """Coefficients (intercept first) of each group from sums of products alone: one aggregation, d^2 numbers a group.

    Rows with a NULL feature or target don't count. Groups are folds: a few.
    """
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    ok = train.dropna(subset=[*features, y])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs] + [F.sum(c * F.col(y)).alias(f"t{i}") for i, c in enumerate(x)]
    out = {}
    for r in ok.groupBy(*(by or [])).agg(*sums).collect():
        a, t = np.zeros((len(x), len(x))), np.array([r[f"t{i}"] or 0.0 for i in range(len(x))])
        for i, j in pairs:
            a[i, j] = a[j, i] = r[f"p{i}_{j}"] or 0.0
        out[tuple(r[c] for c in by or [])] = np.linalg.solve(a + ridge * np.eye(len(x)) * max(1.0, np.trace(a) / len(x)), t)
    return out


def predict(features: list[str], w: np.ndarray) -> Column:
    out = F.lit(float(w[0]))
    for c, k in zip(features, w[1:], strict=True):
        out = out + float(k) * F.col(c)
    return out


def transfer_errors(df: DataFrame, fold: str, arms: dict[str, list[str]], y: str) -> DataFrame:
    """(fold, arm, n, rmse) of a least-squares model fitted on all other folds. One aggregation an arm fits all folds:
    a fold's normal equations are the total's less its own. One scan more gives all errors."""
    folds = [r[0] for r in df.select(fold).distinct().collect()]
    errors = []
    for arm, features in arms.items():
        case = F.lit(None).cast("double")
        fits = _leave_one_out(df, fold, features, y, folds)
        for f in folds:
            case = F.when(F.col(fold) == F.lit(f), F.col(y) - predict(features, fits[f])).otherwise(case)
        errors.append(F.struct(F.lit(arm).alias("arm"), case.alias("e")))
    d = df.select(fold, F.explode(F.array(*errors)).alias("_e"))
    return d.groupBy(fold, F.col("_e.arm").alias("arm")).agg(F.count("_e.e").alias("n"), F.sqrt(F.avg(F.col("_e.e") * F.col("_e.e"))).alias("rmse"))


def _leave_one_out(df: DataFrame, fold: str, features: list[str], y: str, folds: list) -> dict:
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    k = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(k) for j in range(k)] + [F.sum(c * F.col(y)) for c in x]
    own = {r[0]: np.array([v or 0.0 for v in r[1:]], float) for r in df.dropna(subset=[*features, y]).groupBy(fold).agg(*sums).collect()}
    total = sum(own.values())
    out = {}
    for f in folds:
        s = total - own.get(f, 0)
        a = s[: k * k].reshape(k, k)
        out[f] = np.linalg.lstsq(a, s[k * k :], rcond=None)[0]
    return out


def tree_errors(df: DataFrame, fold: str, features: list[str], y: str, *, learner: str = "boosted", trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """(fold, n, rmse) of boosted trees or a random forest (pyspark.ml), fitted on all other folds. Folds are few: a fit each.

    learner 'forest' adds `spread`, the mean deviation of its trees' predictions, as a measure of doubt. Rows with a NULL
    feature or target don't count.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if learner not in ("boosted", "forest"):
        raise ValueError(f"unknown learner: {learner}")
    d = VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=[*features, y]))
    d = kept(d.select(fold, F.col(y).cast("double").alias("_y"), "_x"), "features")
    out = None
    for f in sorted(r[0] for r in d.select(fold).distinct().collect() if r[0] is not None):
        args = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p", "seed": seed, "maxDepth": depth}
        fit = (GBTRegressor(maxIter=trees, **args) if learner == "boosted" else RandomForestRegressor(numTrees=trees, **args)).fit(d.where(F.col(fold) != f))
        test = d.where(F.col(fold) == f)
        if learner == "forest":
            for i, t in enumerate(fit.trees):
                test = t.setPredictionCol(f"_t{i}").transform(test)
            each = F.array(*[f"_t{i}" for i in range(trees)])
            mean = F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / trees
            sd = F.sqrt(F.aggregate(F.transform(each, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / trees)
            test, extra = test.withColumns({"_p": mean, "_sd": sd}), [F.avg("_sd").alias("spread")]
        else:
            test, extra = fit.transform(test), []
        e = F.col("_y") - F.col("_p")
        one = test.groupBy(fold).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), *extra)
        out = one if out is None else out.unionByName(one)
    return out


def principal_axes(train: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, k x d axes) of the rows' covariance; each axis's largest entry is positive.

    Spark adds up d x d partial sums in a tree, JVM-side, so one matrix reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = train.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    mean = v.agg(Summarizer.mean(F.col("v"))).first()[0].toArray()
    axes = PCA(k=k, inputCol="v", outputCol="p").fit(v).pc.toArray().T
    flip = np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])
    return mean, axes * flip[:, None]


def project(vector: str, mean: np.ndarray, axes: np.ndarray) -> Column:
    """Array of the centred vector's products with each axis."""
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    dots = [F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(x)) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for axis in axes]
    return F.array(*dots)


def propensity_weights(df: DataFrame, flag: str, features: list[str], name: str = "weight", low: float = 0.05, high: float = 0.999) -> DataFrame:
    """df with 1 / clipped probability of the flag by logistic regression, the flagged rows' mean scaled to 1; NULL for others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df.withColumn("_y", F.col(flag).cast("double")))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(d.dropna(subset=[*features, "_y"]))
    p = F.greatest(F.lit(low), F.least(F.lit(high), vector_to_array("_p")[1]))
    d = fit.transform(d).withColumn("_w", F.when(F.col(flag), 1 / p))
    return d.crossJoin(F.broadcast(d.agg(F.avg("_w").alias("_m")))).withColumn(name, F.col("_w") / F.col("_m")).select(*df.columns, name)
