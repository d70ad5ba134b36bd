"""As-of, interval, alignment and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.operators.common import bounded, unique_on

#: A group's axis is cut into so many ranges, each of which one task can take.
RANGES = 16


def asof_interval(left: DataFrame, right: DataFrame, by: list[str], on: str, top: str, bottom: str, values: list[str], *, tie: str | None = None, ranges: int = RANGES) -> DataFrame:
    """left with the values of the interval that holds `on`: greatest top <= on in the group, and on < bottom, else NULL.

    Both sides are stacked, and a window carries the last interval forward; intervals come before points at equal places,
    so an exact match counts. Among equal tops the one last by `tie` (default: bottom) wins. Row count and columns of left
    stay; NULL keys match nothing; a NULL bottom matches nothing.

    The window is over (group, range of the axis), so a group that holds most rows is many tasks' work. Each range also
    gets the last interval of the ranges before it, from one row a group and range. ranges=1: whole groups, one shuffle.
    """
    kinds = dict(left.dtypes)
    edges: list = []
    if ranges > 1:
        ends = right.agg(F.percentile_approx(F.col(top).cast(kinds[on]), F.array(*[F.lit(i / ranges) for i in range(1, ranges)]))).first()[0]
        edges = sorted(set(ends or []))
    part = F.lit(0)
    for e in edges:
        part = part + F.when(F.col("_at") >= F.lit(e).cast(kinds[on]), 1).otherwise(0)
    point = left.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).alias("_tie"), F.lit(None).alias("_hit"))
    layer = right.select(
        *by, F.col(top).cast(kinds[on]).alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.col(tie or bottom).alias("_tie"),
        F.struct(F.col(bottom).alias("_bottom"), F.col(top).alias("_top"), *values).alias("_hit"),
    ).where(F.col("_at").isNotNull())
    both = point.unionByName(layer).withColumn("_part", part)
    if edges:
        last = F.max_by("_hit", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_hit")
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*by, "_part").agg(last).withColumn("_hit", F.last("_hit", ignorenulls=True).over(before)).where("_hit IS NOT NULL")
        carried = carried.select(*by, F.lit(None).alias("_at"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.lit(None).alias("_tie"), "_hit", "_part")
        both = both.unionByName(carried)
    w = Window.partitionBy(*by, "_part").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where("_side = 1")
    keyed = F.lit(True)
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    inside = keyed & (F.col("_at") < F.col("_hit._bottom"))
    return both.select("_row.*", *[F.when(inside, F.col(f"_hit.{c}")).alias(c) for c in values])


def interval_exists(points: DataFrame, intervals: DataFrame, by: list[str], on: str, top: str, bottom: str) -> DataFrame:
    """points that some closed interval [top, bottom] of their group covers.

    One shuffle: the running greatest bottom of the intervals that begin at or before a point tells.
    """
    p = points.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_bottom"), F.struct(*points.columns).alias("_row"))
    i = intervals.select(*by, F.col(top).alias("_at"), F.lit(0).alias("_side"), F.col(bottom).alias("_bottom"), F.lit(None).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(i).withColumn("_reach", F.max("_bottom").over(w)).where("_side = 1 AND _reach >= _at").select("_row.*")


def first_containing(points: DataFrame, intervals: DataFrame, by: list[str], on: str, top: str, bottom: str, order: str, values: list[str]) -> DataFrame:
    """points with the values of the first interval (by `order`) of [top, bottom) that holds them; others are left out.

    Equal points are looked up once and stand as often as before. An equi-join on `by` with a range condition: work is
    points times intervals of a group, results are combined before their shuffle.
    """
    once = points.groupBy(*points.columns).agg(F.count("*").alias("_copies"))
    i = intervals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(top).alias("_top"), F.col(bottom).alias("_bottom"), F.col(order).alias("_order"), *[F.col(v).alias(f"_v_{v}") for v in values])
    cond = (F.col("_top") <= F.col(on)) & (F.col(on) < F.col("_bottom"))
    for c in by:
        cond = cond & (F.col(c) == F.col(f"_{c}"))
    best = F.min_by(F.struct(*[F.col(f"_v_{v}").alias(v) for v in values]), "_order").alias("_best")
    met = once.join(i, cond).groupBy(*points.columns, "_copies").agg(best)
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select(*points.columns, "_best.*")


def distinct_enrich(df: DataFrame, keys: list[str], derive) -> DataFrame:
    """df with derive(distinct keys)'s columns: what is costly is done once a key, then joined back on the exact keys."""
    return df.join(derive(df.select(*keys).dropna().distinct()), keys, "left")


def multiset_align(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], order_left: list[str], order_right: list[str], *, strict: bool = False) -> DataFrame:
    """left with right's values, the n-th row of a key to the n-th: a 1:1 join of multisets.

    Unmatched rows of left give NULL, or stop the job if `strict`.
    """

    def numbered(df: DataFrame, order: list[str]) -> DataFrame:
        return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    r = numbered(right, order_right).select(*keys, "_nth", F.lit(True).alias("_hit"), *values)
    out = numbered(left, order_left).join(r, [*keys, "_nth"], "left")
    if strict:
        lost = F.concat(F.lit("no partner for "), F.to_json(F.struct(*keys, "_nth")))
        out = out.withColumn("_hit", F.when(F.col("_hit"), True).otherwise(F.raise_error(lost).cast("boolean"))).where("_hit")
    return out.select(*left.columns, *values)


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows equally often (NULLs equal)."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join whose right side must be unique on the keys (ValueError otherwise)."""
    return left.join(unique_on(right, keys), keys, "left")


def aggregate_then_join(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], value: str, name: str) -> DataFrame:
    """left with the least `value` of the right rows whose (derived) keys are equal."""
    names = [f"_k{i}" for i in range(len(left_keys))]
    least = right.groupBy(*[k.alias(n) for k, n in zip(right_keys, names, strict=True)]).agg(F.min(value).alias(name))
    return left.withColumns(dict(zip(names, left_keys, strict=True))).join(least, names, "left").select(*left.columns, name)


def rounded(c: str | Column, decimals: int = 4) -> Column:
    """A coordinate as a join key: to double first, as rounding a float gives other digits."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), decimals)


def lookup(df: DataFrame, codes: DataFrame, key: str, value: str, default) -> DataFrame:
    """df with `value` of a code table (broadcast if its rows are counted to be few), or the default."""
    return df.join(bounded(codes.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def snap_to_axis(c: Column, start: float, step: float, n: int) -> Column:
    """The nearest of n evenly spaced axis values; a tie goes to the lesser."""
    i = F.ceil((c - start) / step - 0.5)
    return F.lit(start) + F.greatest(F.lit(0), F.least(F.lit(n - 1), i)) * step


def raster_bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, *, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, fill: float) -> DataFrame:
    """points with `sample`: the grid (i, j, value) between its four cells; `fill` outside or where a cell is missing.

    The grid's cells are put side by side four at a time, so that each point is one lookup of the cell it lies in.
    """
    fx, fy = (F.col(x) - x0) / dx, (F.col(y) - y0) / dy
    inside = fx.between(0, nx - 1) & fy.between(0, ny - 1)
    i, j = F.least(F.floor(fx), F.lit(nx - 2)), F.least(F.floor(fy), F.lit(ny - 2))
    places = [(a, b) for a in (0, 1) for b in (0, 1)]
    sent = grid.select(F.explode(F.array(*[F.struct((F.col("i") - a).cast("bigint").alias("_i"), (F.col("j") - b).cast("bigint").alias("_j"), F.lit(2 * a + b).alias("k"), F.col("value").cast("double").alias("v")) for a, b in places])).alias("c")).select("c.*")
    cells = sent.groupBy("_i", "_j").agg(*[F.max(F.when(F.col("k") == 2 * a + b, F.col("v"))).alias(f"_v{a}{b}") for a, b in places])
    asked = points.withColumns({"_i": F.when(inside, i), "_j": F.when(inside, j)})
    met = asked.join(cells, ["_i", "_j"], "left")
    u, v = fx - F.col("_i"), fy - F.col("_j")
    total = sum(((u if a else 1 - u) * (v if b else 1 - v) * F.col(f"_v{a}{b}") for a, b in places), F.lit(0.0))
    return met.select(*points.columns, F.coalesce(total, F.lit(fill)).alias("sample"))


def raster_nearest(points: DataFrame, grid: DataFrame, x: str, y: str, *, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, fill: float) -> DataFrame:
    """points with `sample`: the nearest cell's value; `fill` outside or where the cell is missing."""
    fx, fy = (F.col(x) - x0) / dx, (F.col(y) - y0) / dy
    inside = fx.between(0, nx - 1) & fy.between(0, ny - 1)
    asked = points.withColumns({"_i": F.when(inside, F.floor(fx + 0.5)), "_j": F.when(inside, F.floor(fy + 0.5))})
    g = grid.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias("_v"))
    return asked.join(g, ["_i", "_j"], "left").select(*points.columns, F.coalesce("_v", F.lit(fill)).alias("sample"))


def join_delta(left: DataFrame, a: DataFrame, b: DataFrame, key: str, value: str, owner: str) -> DataFrame:
    """One row: how two joins of the same left rows differ. a, b: (key, owner's id matched as `owner`, value)."""
    x = a.select(key, F.col(value).alias("_va"), F.col(owner).alias("_oa"))
    y = b.select(key, F.col(value).alias("_vb"), F.col(owner).alias("_ob"))
    j = left.select(key, F.col(owner).alias("_own")).join(x, key, "left").join(y, key, "left")
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    has_a, has_b = F.col("_va").isNotNull(), F.col("_vb").isNotNull()
    return j.agg(
        F.count("*").alias("n_rows"), n(has_a).alias("n_a"), n(has_b).alias("n_b"), n(has_a & ~has_b).alias("only_a"), n(~has_a & has_b).alias("only_b"),
        n(has_a & has_b & (F.col("_va") != F.col("_vb"))).alias("changed"), n(has_a & (F.col("_oa") != F.col("_own"))).alias("foreign_a"), n(has_b & (F.col("_ob") != F.col("_own"))).alias("foreign_b"),
    )
