"""Nearest-neighbour, line and polygon joins over planar coordinates, by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.operators.common import BROADCAST_ROWS, bounded, kept

KM_LAT = 110.574
KM_LON = 111.320
#: The first cells of a search hold so many distinct places at most.
PLACES_A_CELL = 64


def planar(df: DataFrame, lat: str, lon: str, lat0: float) -> DataFrame:
    """df with x, y in km by the equirectangular projection around lat0."""
    k = F.cos(F.radians(F.lit(lat0))) * KM_LON
    return df.withColumns({"x": F.col(lon) * k, "y": F.col(lat) * KM_LAT})


def _cells(x: str, y: str, size: float) -> tuple[Column, Column]:
    return F.floor(F.col(x) / size), F.floor(F.col(y) / size)


def _around(df: DataFrame, size: float) -> DataFrame:
    """df once for each of the nine cells that may hold what is within `size`."""
    i, j = _cells("x", "y", size)
    near = F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(near)).withColumns({"_i": F.col("_c.i"), "_j": F.col("_c.j")}).drop("_c")


def _finite(df: DataFrame) -> DataFrame:
    """df without rows whose place isn't known."""
    return df.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))


def _lists(queries: DataFrame, candidates: DataFrame, key: str, values: list[str], k: int, start: float, *, other: str | None = None, reach: float | None = None) -> DataFrame:
    """(x, y, _list): for each distinct place of `queries`, candidates (_d, _id, _v_*) in the order of distance and id, such
    that the first k that a query there may have stand among them; places without any are left out.

    Points of one place share their list, and of the candidates of one place only those go into a search that may be among
    the first k: the k least ids, one more if a query leaves itself out (other is the key), and k of each group, 2k in all,
    if it leaves out its own group (no group but its own is left out, and that has k rows there at most).

    Searches go by rounds of cells, from cells that hold few places each up to `reach`, if there is one: what is found within
    a cell's width is the nearest, so a place in a dense region is done before the cells get wide. A place that has found
    all there is is done too. Rounds are written to the shared folder.
    """
    spark = queries.sparkSession
    group = f"_v_{other}" if other and other != key else None
    keep = 2 * k if group else k + 1 if other else k

    def first(df: DataFrame, *order: str) -> DataFrame:
        if group:
            df = df.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y", group).orderBy(*order))).where(F.col("_r") <= k)
        return df.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy(*order))).where(F.col("_r") <= keep).drop("_r")

    c = _finite(candidates).select("x", "y", F.col(key).alias("_id"), *[F.col(v).alias(f"_v_{v}") for v in values])
    names = c.columns[2:]
    c = kept(first(c, "_id").groupBy("x", "y").agg(F.collect_list(F.struct(*names)).alias("_at")), "places")
    pending = kept(_finite(queries).select("x", "y").distinct(), "places")
    n, rows, x0, x1, y0, y1 = c.agg(F.count("*"), F.sum(F.size("_at")), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    left, tasks = pending.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if group and n:
        most = c.select(F.explode(F.transform("_at", lambda r: r[group])).alias("g")).groupBy("g").agg(F.least(F.count("*"), F.lit(k)).alias("n")).agg(F.sum("n")).first()[0]
    else:
        most = rows or 0
    most = min(most, keep)
    size = min(start, reach or start)
    if n > 1:
        w, h = x1 - x0, y1 - y0
        size = min(size, math.sqrt(w * h * keep / rows) if w and h else (w + h) * keep / rows)
        for _ in range(16):
            if c.groupBy(*_cells("x", "y", size)).count().agg(F.max("count")).first()[0] <= PLACES_A_CELL:
                break
            size /= 4
    out = None
    while left and n:
        i, j = _cells("x", "y", size)
        near = c.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "_at", i.alias("_i"), j.alias("_j"))
        d = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
        met = _around(pending, size).repartition(tasks, "_i", "_j").join(near, ["_i", "_j"]).withColumn("_d", d).where(F.col("_d") <= size)
        met = first(met.select("x", "y", "_d", F.inline("_at")), "_d", "_id")
        found = kept(met.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("_d", *names))).alias("_list")), "knn")
        last = reach is not None and size >= reach
        done = found if last else found.where(F.size("_list") >= most)
        out = done if out is None else out.unionByName(done)
        if last:
            break
        pending = kept(pending.join(done.select("x", "y"), ["x", "y"], "left_anti"), "places")
        left = pending.count()
        size = size * 2 if reach is None else min(size * 2, reach)
    if out is None:
        out = c.select("x", "y", F.transform("_at", lambda r: F.struct(F.lit(0.0).alias("_d"), *[r[m].alias(m) for m in names])).alias("_list")).where("1 = 0")
    out = kept(out, "knn")
    return F.broadcast(out) if out.count() * keep <= BROADCAST_ROWS else out


def _own(rows: str, key: str, k: int, other: str | None) -> Column:
    """The first k of an array of candidates, without those that a query leaves out."""
    mine = {None: lambda r: F.lit(True), key: lambda r: r["_id"] != F.col(key)}.get(other, lambda r: ~r[f"_v_{other}"].eqNullSafe(F.col(other or key)))
    return F.slice(F.filter(rows, mine), 1, k)


def nearest(queries: DataFrame, candidates: DataFrame, key: str, values: list[str], tolerance: float, *, others: bool = False) -> DataFrame:
    """queries with the nearest candidate's values and `distance`, NULL beyond the tolerance; ties go to the least id.

    others: candidates with the query's own key are left out, as in a search of a table in itself.
    """
    other = key if others else None
    lists = _lists(queries, candidates, key, values, 1, tolerance, other=other, reach=tolerance)
    best = F.try_element_at(F.filter(_own("_list", key, 1, other), lambda r: r["_d"] < tolerance), F.lit(1))
    out = queries.join(lists, ["x", "y"], "left").withColumn("_b", best)
    return out.select(*queries.columns, F.col("_b._d").alias("distance"), *[F.col(f"_b._v_{v}").alias(v if v not in queries.columns else f"near_{v}") for v in values])


def _ranked(queries: DataFrame, lists: DataFrame, key: str, k: int, other: str | None) -> DataFrame:
    cols = list(dict.fromkeys([key, *([other] if other else [])]))
    rows = queries.select(*cols, "x", "y").join(lists, ["x", "y"]).select(*cols, F.posexplode(_own("_list", key, k, other)).alias("_p", "_c"))
    return rows.select(*cols, "_c.*", (F.col("_p") + 1).alias("rank"))


def knn_within(queries: DataFrame, candidates: DataFrame, key: str, values: list[str], k: int, reach: float, *, others: bool = False) -> DataFrame:
    """(key, rank, _id, _d, _v_*) of up to k nearest candidates within `reach`; equal distances rank by id."""
    other = key if others else None
    return _ranked(queries, _lists(queries, candidates, key, values, k, reach, other=other, reach=reach), key, k, other)


def knn(queries: DataFrame, candidates: DataFrame, key: str, values: list[str], k: int, start: float, *, other: str | None = None) -> DataFrame:
    """(key, rank, _id, _d, _v_*) of the k nearest candidates without a limit of distance; ids are unique.

    The first cells are `start` wide at most. other: a column of both sides; candidates with the query's value there, or its
    own id where other is the key, are left out.
    """
    values = list(dict.fromkeys([*values, *([other] if other and other != key else [])]))
    return _ranked(queries, _lists(queries, candidates, key, values, k, start, other=other), key, k, other)


def inverse_distance(neighbours: DataFrame, key: str, value: str, *, power: float = 2.0, floor: float = 1e-12) -> DataFrame:
    """(key, idw, nearest): the neighbours' mean weighted by 1 / max(d, floor)^power."""
    w = 1 / F.pow(F.greatest(F.col("_d"), F.lit(floor)), F.lit(power))
    return neighbours.groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), w))).alias("idw"), F.min("_d").alias("nearest"))


def with_fill(queries: DataFrame, found: DataFrame, key: str, fill: dict) -> DataFrame:
    """(key, found's columns) of every query: those that found nothing have the fill values."""
    return queries.select(key).join(found, key, "left").na.fill(fill)


def vote(neighbours: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode): the most frequent value, of equally frequent ones the least."""
    n = neighbours.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def site_code(points: DataFrame, value: str, lat: float, lon: float, *, k: int = 8, reach: float = 200.0) -> DataFrame:
    """One row (value): the most frequent code among the k nearest points within `reach` km of one site, NULL if there is none.

    A top-k of the points around the site, not a join of all.
    """
    near = planar(points, "lat", "lon", lat)
    x, y = lon * math.cos(math.radians(lat)) * KM_LON, lat * KM_LAT
    d = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    top = near.select("id", value, d.alias("_d")).where(F.col("_d") <= reach).orderBy("_d", "id").limit(k)
    votes = top.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    return votes.agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def dissimilarity(queries: DataFrame, train: DataFrame, key: str, start: float, *, mode: str = "train", group: str | None = None) -> DataFrame:
    """(key, distance, dissimilarity): the distance to the nearest training point, over the mean distance of all training pairs.

    mode 'train': to any training point; 'others': leave-one-out, the own id left out; 'groups': to the nearest of another
    group. Both tables have x and y. NULL where the mean distance is 0. Queries without such a point are left out.
    """
    from corelog.operators.aggregates import mean_pairwise_distance

    if mode not in ("train", "others", "groups") or (mode == "groups" and not group):
        raise ValueError(f"unknown mode: {mode}")
    found = knn(queries, train, key, [], 1, start, other={"train": None, "others": key, "groups": group}[mode])
    mean = mean_pairwise_distance(train.select(key, F.array("x", "y").alias("v")), key, "v")
    return found.crossJoin(F.broadcast(mean)).select(key, F.col("_d").alias("distance"), (F.col("_d") / F.nullif(F.col("mean_distance"), F.lit(0.0))).alias("dissimilarity"))


def line_distance(points: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, distance) to the nearest segment (x1, y1, x2, y2); the segments are broadcast if counted to be few."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))
    ex, ey = F.col("x") - F.col("x1") - t * dx, F.col("y") - F.col("y1") - t * dy
    return points.select(key, "x", "y").crossJoin(bounded(segments)).groupBy(key).agg(F.sqrt(F.min(ex * ex + ey * ey)).alias("distance"))


def in_polygon(points: DataFrame, polygons: DataFrame, key: str, order: str, value: str, fill) -> DataFrame:
    """(key, value) of the first polygon, by `order`, that holds the point, else fill.

    polygons: (order, value, ring array of (x, y)), bounding boxes first, then a ray to the right.
    """
    box = polygons.withColumns({"_x0": F.array_min("ring.x"), "_x1": F.array_max("ring.x"), "_y0": F.array_min("ring.y"), "_y1": F.array_max("ring.y")})
    edges = F.zip_with("ring", F.expr("concat(slice(ring, 2, size(ring) - 1), array(ring[0]))"), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))
    box = box.select(F.col(order).alias("_order"), F.col(value).alias("_value"), edges.alias("_edges"), "_x0", "_x1", "_y0", "_y1")
    cond = F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))
    crossings = F.expr("size(filter(_edges, e -> (e.ay > y) <> (e.by > y) AND x < e.ax + (y - e.ay) * (e.bx - e.ax) / (e.by - e.ay)))")
    met = points.select(key, "x", "y").join(bounded(box), cond).where(crossings % 2 == 1)
    first = met.groupBy(key).agg(F.min_by("_value", "_order").alias(value))
    return points.select(key).join(first, key, "left").select(key, F.coalesce(value, F.lit(fill)).alias(value))


def nearest_centre(points: DataFrame, centres: DataFrame, key: str, lat: str, lon: str, name: str) -> DataFrame:
    """(key, name) of the nearest centre (name, clat, clon), longitudes scaled by the cosine of the point's latitude."""
    k = F.cos(F.radians(F.col(lat)))
    d2 = F.pow(F.col(lat) - F.col("clat"), 2) + F.pow((F.col(lon) - F.col("clon")) * k, 2)
    return points.select(key, lat, lon).crossJoin(bounded(centres)).groupBy(key).agg(F.min_by(name, F.struct(d2, F.col(name))).alias(name))
