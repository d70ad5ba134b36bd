"""Rasters and cubes as long tables: blocks, smoothing, gaps, tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelog.operators.common import bounded, kept
from corelog.operators.quantiles import percentiles


def block_mean(grid: DataFrame, factor: int) -> DataFrame:
    """(i, j, value) of blocks of factor x factor cells; NULLs don't count, a block without values is NULL."""
    return grid.groupBy(F.floor(F.col("i") / factor).cast("int").alias("i"), F.floor(F.col("j") / factor).cast("int").alias("j")).agg(F.avg("value").alias("value"))


def block_pick(grid: DataFrame, factor: int) -> DataFrame:
    """The cell in the middle of each block: codes can't be averaged."""
    h = factor // 2
    return grid.where((F.col("i") % factor == h) & (F.col("j") % factor == h)).withColumns({"i": F.floor(F.col("i") / factor).cast("int"), "j": F.floor(F.col("j") / factor).cast("int")})


def smooth(grid: DataFrame, axis: str, other: str, sigma: float) -> DataFrame:
    """(i, j, s, w): sums of kernel weight x value and of weight along one axis; at an edge the last cell repeats.

    Each cell is sent to the cells that it reaches, with partial sums before the shuffle; edges send the repeated weights.
    Cells that the grid lacks aren't made.
    """
    r = int(4 * sigma + 0.5)
    k = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    k = [x / sum(k) for x in k]
    ends = grid.agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    sent = F.array(*[F.struct((F.col(axis) - o).alias("at"), F.lit(k[o + r]).alias("w"), F.lit(o == 0).alias("own")) for o in range(-r, r + 1)])
    inner = F.filter(sent, lambda x: x["at"].between(lo, hi))
    # a cell p sees offsets beyond an edge as the edge cell: the edge sends p the kernel's tail
    tail = lambda p, sign: F.aggregate(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k[o + r]).alias("w")) for o in range(1, r + 1)]), F.lit(0.0), lambda a, x: a + F.when(x["o"] > sign * (F.when(F.lit(sign) > 0, hi).otherwise(lo) - p), x["w"]).otherwise(0.0))
    reach = lambda at, sign: F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda q: F.struct((at - sign * q).alias("at"), tail(at - sign * q, sign).alias("w"), F.lit(False).alias("own")))
    edge = F.concat(
        F.when(F.col(axis) == hi, reach(hi, 1)).otherwise(F.array()), F.when(F.col(axis) == lo, reach(lo, -1)).otherwise(F.array()),
    )
    edge = F.filter(edge, lambda x: x["at"].between(lo, hi))
    d = grid.crossJoin(F.broadcast(ends)).withColumn("_t", F.explode(F.concat(inner, edge)))
    return d.groupBy(F.col("_t.at").alias(axis), other).agg(F.sum(F.col("_t.w") * F.col("s")).alias("s"), F.sum(F.col("_t.w") * F.col("w")).alias("w"), F.bool_or("_t.own").alias("_own")).where("_own").drop("_own")


def gaussian(grid: DataFrame, sigma: float, *, axes: tuple[str, ...] = ("i", "j"), least: float = 1e-3) -> DataFrame:
    """(i, j, value): Gaussian smoothing that leaves NULLs out, NULL where the weight is below `least`."""
    d = grid.select("i", "j", F.coalesce("value", F.lit(0.0)).alias("s"), F.col("value").isNotNull().cast("double").alias("w"))
    for a in axes:
        d = smooth(d, a, "j" if a == "i" else "i", sigma)
    return d.select("i", "j", F.when(F.col("w") >= least, F.col("s") / F.col("w")).alias("value"))


def fill_thin_gaps(grid: DataFrame) -> DataFrame:
    """NULL cells between two values become their mean, along j first, then along i."""
    for line, along in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(line).orderBy(along)
        mean = (F.lag("value").over(w) + F.lead("value").over(w)) / 2
        grid = grid.withColumn("value", F.coalesce("value", mean))
    return grid


def edges(df: DataFrame, c: str) -> DataFrame:
    """(c, low, high): borders of cells half way between centres, the outer ones as far out as in."""
    w = Window.partitionBy().orderBy(c)
    up, down = F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w)
    return df.select(c, (F.col(c) - F.coalesce(down, up) / 2).alias("low"), (F.col(c) + F.coalesce(up, down) / 2).alias("high"))


def merge_tiles(cells: DataFrame, keys: list[str], tile: str, value: str) -> DataFrame:
    """(keys, value) of overlapping tiles: the last tile wins; a tile that has a key twice is an error."""
    once = cells.groupBy(*keys, tile).agg(F.count("*").alias("_n"), F.max(value).alias(value))
    checked = F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("a tile holds a cell twice")).cast("double"))
    return once.withColumn(value, checked).groupBy(*keys).agg(F.max_by(value, tile).alias(value))


def tiles_covering(tiles: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Tiles (min_x, max_x, min_y, max_y) whose closed bounds meet the box; ValueError if there are none."""
    out = tiles.where((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))
    if out.isEmpty():
        raise ValueError("no tile meets the box")
    return out


def half_width(cells: DataFrame, multipliers: DataFrame, regime: str, sd: str, marginal: float | None, z: float) -> DataFrame:
    """cells with half_width = sd x the regime's multiplier, else the marginal one, else z."""
    out = cells.join(bounded(multipliers.select(regime, "q")), regime, "left")
    return out.withColumn("half_width", F.col(sd) * F.coalesce("q", F.lit(marginal).cast("double"), F.lit(z))).drop("q")


#: Metres of a degree of latitude.
DEGREE = 111_320.0


def degree_steps(metres: float, lat: float, floor: float = 1e-6) -> tuple[float, float]:
    """Steps of latitude and longitude, in degrees, of a grid of so many metres around a latitude."""
    return metres / DEGREE, metres / DEGREE / max(floor, abs(math.cos(math.radians(lat))))


def global_axes(south: float, north: float, west: float, east: float, metres: float, margin: int = 2) -> tuple[tuple[float, float, int], tuple[float, float, int]]:
    """((first, last, cells) of latitude, the same of longitude): axes over a box, padded by `margin` cells on each side.

    The step of longitude is that at the southern border. The cells are evenly spaced from first to last.
    """
    if margin < 0:
        raise ValueError("margin must be 0 or more")
    out = []
    for low, high, step in ((south, north, metres / DEGREE), (west, east, metres / (DEGREE * math.cos(math.radians(south))))):
        low, high = low - margin * step, high + margin * step
        out.append((low, high, round((high - low) / step) + 1))
    return out[0], out[1]


def axis(spark: SparkSession, first: float, last: float, cells: int, name: str) -> DataFrame:
    """(n, name): evenly spaced values from first to last, both exact."""
    d = spark.range(cells).toDF("n")
    return d.select("n", (F.lit(first) + F.col("n") * F.lit((last - first) / max(cells - 1, 1))).alias(name))


def regular_cells(spark: SparkSession, south: float, north: float, west: float, east: float, metres: float) -> DataFrame:
    """(lat, lon): points of a regular grid of so many metres from a box's south-west corner to its north and east, by the
    middle latitude's steps."""
    d_lat, d_lon = degree_steps(metres, (south + north) / 2)
    n, m = (math.floor((b + d / 2 - a) / d) + 1 for a, b, d in ((south, north, d_lat), (west, east, d_lon)))
    lat = spark.range(n).select((F.lit(south) + F.col("id") * d_lat).alias("lat"))
    return lat.crossJoin(F.broadcast(spark.range(m).select((F.lit(west) + F.col("id") * d_lon).alias("lon"))))


def native_spacing(cells: DataFrame, tile: str, c: str) -> float:
    """The median over tiles of the median step of a tile's distinct values of c. ValueError if no tile has two."""
    w = Window.partitionBy(tile).orderBy(c)
    steps = cells.select(tile, c).distinct().withColumn("_s", F.col(c) - F.lag(c).over(w)).where("_s IS NOT NULL")
    each = percentiles(steps, [tile], "_s", {"_m": 0.5})
    got = percentiles(each, [], "_m", {"_q": 0.5}).first()
    if got is None:
        raise ValueError("no tile has two values")
    return got["_q"]


def regrid(cells: DataFrame, tile: str, y: str, x: str, value: str) -> DataFrame:
    """(y, x, value): tiles of regular cells put on one even grid of the median native spacing, by bilinear interpolation
    inside each tile; where tiles overlap the last one wins.

    The target's ends are those of all cells. A target point belongs to a tile if it lies within its ends. Each tile's four
    corners around a target stand in one row of the tile's cells, found by an equi-join; a NULL corner gives no value.
    """
    spark = cells.sparkSession
    cells = kept(cells.select(tile, F.col(y).alias("_y"), F.col(x).alias("_x"), F.col(value).cast("double").alias("_v")), "cells")
    ends = cells.agg(F.min("_y"), F.max("_y"), F.min("_x"), F.max("_x")).first()
    axes = []
    for c, lo, hi in (("_y", ends[0], ends[1]), ("_x", ends[2], ends[3])):
        step = native_spacing(cells, tile, c)
        n = max(round((hi - lo) / step) + 1, 1)
        axes.append((lo, (hi - lo) / max(n - 1, 1), n))
    # Each tile's own axes, numbered, with the next value: a target lies between a value and the next.
    def numbered(c: str) -> DataFrame:
        w = Window.partitionBy(tile).orderBy(c)
        return cells.select(tile, c).distinct().select(tile, c, F.row_number().over(w).alias(f"{c}n"), F.lead(c).over(w).alias(f"{c}b"))

    def targets(c: str, lo: float, step: float, n: int) -> DataFrame:
        """(tile, target, number of the value below, share of the way to the next)."""
        d = numbered(c)
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - lo) / step - 1e-9)) if step else F.lit(0)
        last = F.least(F.lit(n - 1), F.when(F.col(f"{c}b").isNull(), F.floor((F.col(c) - lo) / step + 1e-9)).otherwise(F.ceil((F.col(f"{c}b") - lo) / step - 1e-9) - 1)) if step else F.lit(0)
        d = d.where(first <= last).withColumn("_t", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
        at = F.lit(lo) + F.col("_t") * step
        part = F.greatest(F.lit(0.0), F.coalesce((at - F.col(c)) / (F.col(f"{c}b") - F.col(c)), F.lit(0.0)))
        return d.select(tile, F.col("_t").alias(f"{c}t"), F.col(f"{c}n").cast("bigint").alias(f"{c}n"), part.alias(f"{c}s"))

    placed = cells.join(numbered("_y").drop("_yb"), [tile, "_y"]).join(numbered("_x").drop("_xb"), [tile, "_x"]).select(tile, F.col("_yn").cast("bigint").alias("_yn"), F.col("_xn").cast("bigint").alias("_xn"), "_v")
    corners = F.explode(F.array(*[F.struct((F.col("_yn") - a).alias("yn"), (F.col("_xn") - b).alias("xn"), F.lit(2 * a + b).alias("k"), F.col("_v").alias("v")) for a in (0, 1) for b in (0, 1)]))
    quads = placed.select(tile, corners.alias("c")).groupBy(tile, F.col("c.yn").alias("_yn"), F.col("c.xn").alias("_xn")).agg(*[F.max(F.when(F.col("c.k") == k, F.col("c.v"))).alias(f"_v{k}") for k in range(4)])
    asked = targets("_y", *axes[0]).join(targets("_x", *axes[1]), tile)
    met = asked.join(quads, [tile, "_yn", "_xn"])
    a, b = F.col("_ys"), F.col("_xs")
    # A corner whose weight is 0 isn't needed: the last line of a tile has none beyond it.
    part = lambda w, k: F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(f"_v{k}"))
    v = part((1 - a) * (1 - b), 0) + part((1 - a) * b, 1) + part(a * (1 - b), 2) + part(a * b, 3)
    best = met.withColumn("_r", v).groupBy("_yt", "_xt").agg(F.max_by("_r", tile).alias(value))
    return best.select((F.lit(axes[0][0]) + F.col("_yt") * axes[0][1]).alias(y), (F.lit(axes[1][0]) + F.col("_xt") * axes[1][1]).alias(x), value)


def transect(cells: DataFrame, y: str, x: str, depth: str, value: str, at: float, x0: float, x1: float, n: int) -> DataFrame:
    """(x, depth, value) of n even places from x0 to x1 on the line y = at: linear between the two rows of cells beside the
    line, the nearest column in x (ties: the lesser)."""
    rows = cells.agg(F.max(F.when(F.col(y) <= at, F.col(y))).alias("lo"), F.min(F.when(F.col(y) >= at, F.col(y))).alias("hi")).first()
    if rows.lo is None or rows.hi is None:
        raise ValueError("the line lies outside the cells")
    share = 0.0 if rows.hi == rows.lo else (at - rows.lo) / (rows.hi - rows.lo)
    two = cells.where(F.col(y).isin(rows.lo, rows.hi))
    line = two.groupBy(x, depth).agg(F.max(F.when(F.col(y) == rows.lo, F.col(value))).alias("_a"), F.max(F.when(F.col(y) == rows.hi, F.col(value))).alias("_b"))
    line = line.select(F.col(x).alias("_x"), depth, ((1 - share) * F.col("_a") + share * F.col("_b")).alias(value))
    places = axis(cells.sparkSession, x0, x1, n, x)
    # One row of cells is as many columns as the raster is wide.
    near = places.crossJoin(bounded(line.select("_x").distinct(), "columns")).groupBy("n", x).agg(F.min_by("_x", F.struct(F.abs(F.col("_x") - F.col(x)), "_x")).alias("_x"))
    return near.join(line, "_x").select(x, depth, value)
