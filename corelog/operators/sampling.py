"""Samples, splits and permutations in a hashed order: the same in every run and in every engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.operators.common import bounded, hashed, kept


def per_stratum(df: DataFrame, entity: str, strata: list[str], k: int, seed: int) -> DataFrame:
    """All rows of up to k entities of each stratum, chosen by hash: a window over distinct entities, then a semi-join."""
    w = Window.partitionBy(*strata).orderBy(hashed(seed, entity), entity)
    chosen = df.select(*strata, entity).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return df.join(chosen, [*strata, entity], "left_semi").select(df.columns)


def fraction(df: DataFrame, entity: str, share: float, seed: int) -> Column:
    """Condition that holds for about `share` of entities, whole: the hash's first eight digits against a threshold."""
    return F.conv(F.substring(hashed(seed, entity), 1, 8), 16, 10).cast("bigint") < int(share * 2**32)


def hashed_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with `_r`, its place (from 1) in hashed order, and `_n`, the number of rows; keys are unique.

    No window holds all rows: the hash's first three digits cut them into 4,096 ranges, whose sizes add up to the places
    at which the ranges begin.
    """
    d = df.withColumn("_h", hashed(seed, key)).withColumn("_p", F.substring("_h", 1, 3))
    sizes = d.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    return d.join(F.broadcast(sizes), "_p").withColumn("_r", place + F.col("_b")).drop("_h", "_p", "_b")


def exactly(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in hashed order without replacement (all if there are fewer); a top-n, not a sort of all."""
    return df.orderBy(hashed(seed, key), key).limit(n)


def balanced(df: DataFrame, key: str, regime: str, n: int, alpha: float, seed: int) -> DataFrame:
    """df with `copies`: n draws with replacement, weight (1 / regime's rows)^alpha, by systematic sampling in each regime.

    The regime gets its share of n; its rows take copies at even steps in hashed order. No row order is global.
    """
    sizes = df.groupBy(regime).agg(F.count("*").alias("_c"))
    mass = F.col("_c") * F.pow(1.0 / F.col("_c"), F.lit(alpha))
    sizes = sizes.withColumn("_q", F.round(n * mass / F.sum(mass).over(Window.partitionBy()), 6))
    w = Window.partitionBy(regime).orderBy(hashed(seed, key), key)
    d = df.join(bounded(sizes, "sizes"), regime).withColumn("_r", F.row_number().over(w))
    return d.withColumn("copies", (F.floor(F.col("_r") * F.col("_q") / F.col("_c") + 1e-9) - F.floor((F.col("_r") - 1) * F.col("_q") / F.col("_c") + 1e-9)).cast("bigint")).where("copies > 0").drop("_c", "_q", "_r")


def tempered_budgets(sizes: dict, n: int) -> dict:
    """Whole shares of n by the square roots of the strata's sizes, none above its size.

    Shares are rounded to even; what rounding leaves goes to the first stratum by name; what sizes cut off goes to the
    strata in the order of their size (ties by name) as far as they have room.
    """
    names = sorted(sizes)
    total = sum(math.sqrt(sizes[k]) for k in names)
    out = {k: round(n * math.sqrt(sizes[k]) / total) for k in names} if total else dict.fromkeys(names, 0)
    if names:
        out[names[0]] = max(0, out[names[0]] + n - sum(out.values()))
    out = {k: min(v, sizes[k]) for k, v in out.items()}
    left = n - sum(out.values())
    for k in sorted(names, key=lambda k: (-sizes[k], k)):
        more = max(0, min(sizes[k] - out[k], left))
        out[k] += more
        left -= more
    return out


def budget_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """Rows of each stratum, the first in hashed order, as many as tempered_budgets gives it. Strata are few: they are counted
    on the driver. NULL is a stratum like any other."""
    d = df.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("\0")))
    k = tempered_budgets({r[0]: r[1] for r in d.groupBy("_s").count().collect()}, n)
    if not k:
        return df
    most = F.create_map(*[F.lit(x) for pair in k.items() for x in pair])[F.col("_s")]
    w = Window.partitionBy("_s").orderBy(hashed(seed, key), key)
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(df.columns)


def seeded_centres(df: DataFrame, key: str, vector: str, k: int, seed: int) -> DataFrame:
    """(place, key, vector) of k rows by k-means++: each next one is drawn with the squared distance to its nearest centre as weight.

    A draw is the least -ln(u) / weight with u from a seeded hash of row and place, so one aggregation a centre, without a
    collect of rows. Distances to the centres so far are in the plan's columns; every 16 centres they are written. A row of
    distance 0 is drawn only if no other is left; rows with NULL vectors never. Fewer than k rows: all of them.
    """
    d = kept(df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_v"), F.lit(float("inf")).alias("_d")), "rows")
    centres: list = []
    for place in range(k):
        u = (F.conv(F.substring(hashed(seed, key, F.lit(place)), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
        race = F.when(F.col("_d") == float("inf"), -F.log(u)).when(F.col("_d") > 0, -F.log(u) / F.col("_d"))
        free = ~F.col(key).isin([c[0] for c in centres]) if centres else F.lit(True)
        best = d.where(free).agg(F.min_by(F.struct(key, "_v"), F.struct(race.isNull(), race, key)).alias("b")).first().b
        if best is None:
            break
        centres.append((best[key], list(best["_v"])))
        far = F.aggregate(F.zip_with("_v", F.array(*map(F.lit, best["_v"])), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        d = d.withColumn("_d", F.least("_d", far))
        if place % 16 == 15:
            d = kept(d, "rows")
    return df.sparkSession.createDataFrame([(i, c, v) for i, (c, v) in enumerate(centres)], f"place int, {key} {dict(df.dtypes)[key]}, {vector} array<double>")


def permuted(df: DataFrame, key: str, strata: list[str], values: list[str], seed: int) -> DataFrame:
    """df with `values` permuted inside strata: a cyclic shift in hashed order, so that none keeps its own unless alone."""
    s = [f"_s{i}" for i in range(len(strata))]
    d = df.select(key, *[F.col(c).alias(n) for c, n in zip(strata, s)], *[F.col(v).alias(f"_v_{v}") for v in values])
    w = Window.partitionBy(*s).orderBy(hashed(seed, key), key)
    donors = [F.coalesce(F.lead(F.struct(f"_v_{v}")).over(w), F.first(F.struct(f"_v_{v}")).over(w))[f"_v_{v}"].alias(f"_v_{v}") for v in values]
    given = d.select(key, *donors)
    rest = [c for c in df.columns if c not in values]
    return df.select(*rest).join(given, key).select(*rest, *[F.col(f"_v_{v}").alias(v) for v in values])


def block_permutation(df: DataFrame, row: str, group: str, depth: str, stratum: str | None, seed: int) -> DataFrame:
    """(row, donor): a bijection of rows that moves whole groups to others of equal length in their stratum.

    Groups of equal (stratum, length) shift cyclically in hashed order: rank r receives the donor's rank r. A group that
    is alone there joins the stratum's rest, where each rank shifts among the groups long enough; a rank alone keeps its
    own row. A group's stratum is that of its first row by depth.
    """
    d = df.select(F.col(row).alias("_row"), F.col(group).alias("_g"), F.col(depth).alias("_d"), (F.col(stratum) if stratum else F.lit("")).alias("_s"))
    by = Window.partitionBy("_g")
    d = d.select("_row", "_g", F.row_number().over(by.orderBy("_d", "_row")).alias("_k"), F.count("*").over(by).alias("_len"), F.first("_s").over(by.orderBy("_d", "_row")).alias("_s"))
    g = d.where("_k = 1").select("_g", "_s", "_len", hashed(seed, "_g").alias("_h"))
    peers = g.withColumn("_peers", F.count("*").over(Window.partitionBy("_s", "_len")))
    d = d.join(peers.select("_g", "_peers", "_h"), "_g")
    block = F.when(F.col("_peers") > 1, F.col("_len")).otherwise(F.lit(-1))
    w = Window.partitionBy("_s", block, "_k").orderBy("_h", "_g")
    donor = F.coalesce(F.lead("_row").over(w), F.first("_row").over(w))
    return d.select(F.col("_row").alias(row), donor.alias("donor"), (F.col("_peers") > 1).alias("_block"))


def permutation_report(moved: DataFrame, row: str) -> DataFrame:
    """One row of diagnostics: rows, whether it is a bijection, shares moved by block, by rank, kept."""
    own = F.col(row) == F.col("donor")
    return moved.agg(
        F.count("*").alias("n_rows"), (F.count_distinct("donor") == F.count("*")).alias("is_bijection"),
        F.round(F.avg(F.col("_block").cast("int")), 6).alias("by_block"), F.round(F.avg((~F.col("_block") & ~own).cast("int")), 6).alias("by_rank"), F.round(F.avg(own.cast("int")), 6).alias("kept"),
    )


def clipped_permutation(df: DataFrame, row: str, group: str, depth: str, seed: int) -> DataFrame:
    """(row, donor) of the older, non-bijective rule: the next group in hashed order gives, its last rank again for all beyond its length."""
    by = Window.partitionBy("_g")
    d = df.select(F.col(row).alias("_row"), F.col(group).alias("_g"), F.row_number().over(Window.partitionBy(group).orderBy(depth, row)).alias("_k"))
    g = d.groupBy("_g").agg(F.max("_k").alias("_len"))
    g = hashed_rank(g, "_g", seed)
    givers = g.select(F.struct("_g", "_len").alias("_from"), F.col("_r").alias("_at"))
    g = g.withColumn("_at", F.col("_r") % F.col("_n") + 1).join(givers, "_at").select("_g", "_from")
    asked = d.join(g, "_g").select("_row", F.col("_from._g").alias("_g"), F.least("_k", "_from._len").alias("_k"))
    return asked.join(d.withColumnRenamed("_row", "donor"), ["_g", "_k"]).select(F.col("_row").alias(row), "donor")
