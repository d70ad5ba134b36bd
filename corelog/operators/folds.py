"""Folds and splits: regions, meshes, blocks, budgets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelog.operators.common import bounded, hashed, kept
from corelog.operators.sampling import hashed_rank

#: name, south, north, west, east
Box = tuple[str, float, float, float, float]


def _inside(lat: Column, lon: Column, box: Box, *, half_open: bool = False) -> Column:
    _, s, n, w, e = box
    return (lat >= s) & (lon >= w) & ((lat < n) & (lon < e) if half_open else (lat <= n) & (lon <= e))


def region_folds(df: DataFrame, lat: str, lon: str, boxes: Iterable[Box]) -> DataFrame:
    """df once for each closed box that holds the row, as `fold`; boxes may overlap, rows in none are left out."""
    names = F.array(*[F.when(_inside(F.col(lat), F.col(lon), b), F.lit(b[0])) for b in boxes])
    return df.withColumn("fold", F.explode(F.array_compact(names)))


def block_folds(df: DataFrame, lat: str, lon: str, boxes: list[Box], blocks: dict[str, list[str]]) -> DataFrame:
    """df once for each block, as `fold`, of which some region holds the row. Unknown regions are a ValueError."""
    known = {b[0]: b for b in boxes}
    if bad := {r for rs in blocks.values() for r in rs} - set(known):
        raise ValueError(f"unknown regions: {sorted(bad)}")

    def hit(regions: list[str]) -> Column:
        out = F.lit(False)
        for r in regions:
            out = out | _inside(F.col(lat), F.col(lon), known[r])
        return out

    return df.withColumn("fold", F.explode(F.array_compact(F.array(*[F.when(hit(rs), F.lit(k)) for k, rs in blocks.items()]))))


def first_region(lat: Column, lon: Column, boxes: list[Box]) -> Column:
    """The first closed box that holds the point, else NULL."""
    return F.coalesce(*[F.when(_inside(lat, lon, b), F.lit(b[0])) for b in boxes])


def last_region(lat: Column, lon: Column, boxes: list[Box]) -> Column:
    """The last box, without its northern and eastern borders, that holds the point, else NULL."""
    return F.coalesce(*[F.when(_inside(lat, lon, b, half_open=True), F.lit(b[0])) for b in reversed(boxes)])


def greedy_folds(df: DataFrame, cell: str, k: int, seed: int) -> DataFrame:
    """df with `fold`: whole cells, in hashed order, each to the fold of fewest rows so far.

    Cells are counted in Spark; the assignment runs over the cell table (one row a cell) on the driver, row by row as it
    arrives, and comes back as a table that is broadcast if it is small.
    """
    spark = df.sparkSession
    counts = df.groupBy(cell).agg(F.count("*").alias("n")).orderBy(hashed(seed, cell), cell)
    load, rows = [0] * k, []
    for r in counts.toLocalIterator():
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += r.n
        rows.append((r[0], f))
    assigned = spark.createDataFrame(rows, f"{cell} {dict(df.dtypes)[cell]}, fold int")
    return df.join(bounded(assigned), cell)


def contiguous_folds(df: DataFrame, cell: str, y: Column, x: Column, k: int, *, seed: int = 42) -> DataFrame:
    """df with `fold`: k regions of neighbouring cells, by k-means of the cells' centres (y, x: expressions over `cell`).

    Cells count once each, whatever their rows; the fit runs on the cell table in Spark. Folds are numbered from the south
    and west. Fewer than k cells is a ValueError.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    cells = kept(df.select(cell).distinct().select(cell, y.alias("_y"), x.alias("_x")), "cells")
    if cells.limit(k).count() < k:
        raise ValueError(f"fewer than {k} cells")
    v = VectorAssembler(inputCols=["_y", "_x"], outputCol="_v").transform(cells)
    best = min((KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="_p", maxIter=50).fit(v) for i in range(3)), key=lambda m: m.summary.trainingCost)
    rank = {i: n for n, i in enumerate(sorted(range(k), key=lambda i: tuple(best.clusterCenters()[i])))}
    number = F.create_map(*[F.lit(a) for pair in rank.items() for a in pair])[F.col("_p")]
    return df.join(bounded(best.transform(v).select(cell, number.alias("fold"))), cell)


def leave_out(df: DataFrame, label: str, held: list[str] | None = None, *, other: str = "other") -> DataFrame:
    """(df's columns, fold, test): df once for each label that is held out; rows of `other`, and unlabelled ones, always train.

    held: the labels, by default all that occur. Labels without a row make no fold.
    """
    d = df.withColumn("_l", F.coalesce(F.col(label), F.lit(other)))
    found = sorted(r[0] for r in d.select("_l").distinct().collect() if r[0] != other)
    folds = [x for x in (found if held is None else held) if x in set(found)]
    if not folds:
        return df.withColumns({"fold": F.lit(None).cast("string"), "test": F.lit(None).cast("boolean")}).where("1 = 0")
    return d.withColumn("fold", F.explode(F.array(*map(F.lit, folds)))).withColumn("test", F.col("_l") == F.col("fold")).drop("_l")


def disjoint_split(df: DataFrame, cell: str, fraction: float, seed: int) -> DataFrame:
    """df with `cal`: whole cells, in hashed order, until they hold the fraction of rows. The window is over cells."""
    c = df.groupBy(cell).agg(F.count("*").alias("_n"))
    w = Window.partitionBy().orderBy(hashed(seed, cell), cell)
    before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    total = F.sum("_n").over(Window.partitionBy())
    return df.join(bounded(c.select(cell, (before < fraction * total).alias("cal"))), cell)


def category_holdout(df: DataFrame, column: str, held: list) -> DataFrame:
    """df with `test`: rows of the held values. A value that isn't there, no test row or no other row is a ValueError."""
    d = df.withColumn("test", F.coalesce(F.col(column).isin(held), F.lit(False)))
    n = {r[column]: r.n for r in d.where("test").groupBy(column).agg(F.count("*").alias("n")).collect()}
    if missing := set(held) - set(n):
        raise ValueError(f"not in {column}: {sorted(missing)}")
    if not held or d.where("NOT test").isEmpty():
        raise ValueError("nothing held out, or everything")
    return d


def year_bin(year: Column) -> Column:
    """'<=1979', decades, '>=2020'; NULL stays."""
    return F.when(year <= 1979, "<=1979").when(year >= 2020, ">=2020").when(year.isNotNull(), F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def guarded_folds(df: DataFrame, fold: str, least_test: int = 30, least_train: int = 100) -> DataFrame:
    """(fold, n_test, n_train) of folds with enough rows on either side."""
    g = df.groupBy(fold).agg(F.count("*").alias("n_test"))
    return g.withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")).where((F.col("n_test") >= least_test) & (F.col("n_train") >= least_train))


def provenance_folds(df: DataFrame, entity: str, families: dict[str, Column], *, top: int = 8, floor: int = 50, least_test: int = 30, least_train: int = 100) -> DataFrame:
    """(family, fold, n_entities, n_test, n_train): leave-one-label-out folds of each family of labels.

    A family's folds are its `top` labels by distinct entities (ties by label) that have `floor` rows; NULL labels make no
    fold. Training rows are all others, those without a label included. Folds with too few rows on a side are dropped.
    All families come from one scan; what is ranked is a row a label.
    """
    labels = F.array(*[F.struct(F.lit(name).alias("family"), c.cast("string").alias("fold")) for name, c in families.items()])
    long = df.select(F.col(entity).alias("_e"), F.explode(labels).alias("l")).select("_e", "l.*")
    g = long.groupBy("family", "fold").agg(F.count_distinct("_e").alias("n_entities"), F.count("*").alias("n_test"))
    g = g.withColumn("n_train", F.sum("n_test").over(Window.partitionBy("family")) - F.col("n_test")).where("fold IS NOT NULL")
    g = g.withColumn("_r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n_entities"), "fold"))).where((F.col("_r") <= top) & (F.col("n_test") >= floor))
    return g.where((F.col("n_test") >= least_test) & (F.col("n_train") >= least_train)).drop("_r")


def few_shot(df: DataFrame, group: str, source: Column, budgets: list[int], holdout: float, seed: int) -> DataFrame:
    """(df's columns, budget, part): for each budget the source rows and the first `budget` target groups as 'train', and
    the same held-out target groups as 'test'. Groups go in hashed order; those held out are the last ones."""
    t = hashed_rank(df.where(~source).select(group).distinct(), group, seed)
    t = t.withColumn("_test", F.col("_r") > F.ceil(F.col("_n") * (1 - holdout))).drop("_n")
    d = df.withColumn("_src", source).join(bounded(t), group, "left")
    d = d.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    part = F.when(F.col("_src"), "train").when(F.col("_test"), "test").when(F.col("_r") <= F.col("budget"), "train")
    return d.withColumn("part", part).where("part IS NOT NULL").drop("_src", "_r", "_test")


#: Steps of latitude and longitude of the meshes by level.
STEPS = {1: (2 / 3, 1.0), 2: (1 / 12, 0.125), 4: (1 / 120, 0.0125)}


def mesh_level(tile_km: float) -> int:
    """The level whose meshes are nearest to the size without exceeding it: 4 up to 5 km, 2 up to 30 km, else 1."""
    return 4 if tile_km <= 5 else 2 if tile_km <= 30 else 1


def tiles(spark: SparkSession, south: float, north: float, west: float, east: float, tile_km: float, halo_km: float) -> DataFrame:
    """(i, j, south, north, west, east, and the same with a halo): the mesh tiles that meet the box, aligned to the mesh.

    The halo is in km: in longitude it widens with the cosine of the tile's middle latitude (0.1 at least).
    """
    step_lat, step_lon = STEPS[mesh_level(tile_km)]
    rows, cols = lattice(south, north, west, east, step_lat, step_lon)
    d = spark.range(rows.start, rows.stop).toDF("i").crossJoin(F.broadcast(spark.range(cols.start, cols.stop).toDF("j")))
    d = d.select("i", "j", (F.col("i") * step_lat).alias("south"), ((F.col("i") + 1) * step_lat).alias("north"), (F.col("j") * step_lon).alias("west"), ((F.col("j") + 1) * step_lon).alias("east"))
    up = F.lit(halo_km / 111.32)
    side = up / F.greatest(F.lit(0.1), F.cos(F.radians((F.col("south") + F.col("north")) / 2)))
    return d.select("*", (F.col("south") - up).alias("halo_south"), (F.col("north") + up).alias("halo_north"), (F.col("west") - side).alias("halo_west"), (F.col("east") + side).alias("halo_east"))


def lattice(south: float, north: float, west: float, east: float, step_lat: float, step_lon: float) -> tuple[range, range]:
    """Indices of the cells of a grid aligned to 0 that meet the box."""
    import math

    return range(math.floor(south / step_lat), math.ceil(north / step_lat)), range(math.floor(west / step_lon), math.ceil(east / step_lon))
