"""Queries over rasters as long tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corelog.operators import grids as G
from corelog.operators import spatial
from corelog.queries.inputs import GRID, POINTS, PREDICTIONS, grid, points, predictions
from corelog.registry import query, table


@query(f"WITH {GRID} SELECT CAST(floor(i / 4) AS INT) AS i, CAST(floor(j / 4) AS INT) AS j, round(avg(value), 4) AS value FROM grid GROUP BY 1, 2")
def grid_block_mean(s, d):
    """G1."""
    return G.block_mean(grid(s, d), 4).withColumn("value", F.round("value", 4))


@query(f"WITH {GRID} SELECT CAST(floor(i / 4) AS INT) AS i, CAST(floor(j / 4) AS INT) AS j, code FROM grid WHERE i % 4 = 2 AND j % 4 = 2")
def grid_block_codes(s, d):
    """G2."""
    return G.block_pick(grid(s, d), 4).select("i", "j", "code")


_K = [math.exp(-0.5 * (o / 1.5) ** 2) for o in range(-6, 7)]
_KERNEL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({o - 6}, CAST({x / sum(_K)!r} AS DOUBLE))" for o, x in enumerate(_K)) + ") AS t(o, w))"
_PASS = """{b} AS (SELECT p.i, p.j, sum(k.w * g.s) AS s, sum(k.w * g.w) AS w FROM {a} p CROSS JOIN k JOIN {a} g
ON g.{x} = greatest((SELECT min({x}) FROM {a}), least((SELECT max({x}) FROM {a}), p.{x} + k.o)) AND g.{y} = p.{y} GROUP BY p.i, p.j)"""
_FULL = "grid0 AS (SELECT i, j, coalesce(value, 0) AS s, CASE WHEN value IS NULL THEN 0e0 ELSE 1e0 END AS w FROM grid)"


@query(f"""WITH {GRID}, {_KERNEL}, {_FULL}, {_PASS.format(a='grid0', b='g1', x='i', y='j')}, {_PASS.format(a='g1', b='g2', x='j', y='i')}
SELECT i, j, round(CASE WHEN w >= 1e-3 THEN s / w END, 4) AS value FROM g2""")
def grid_smooth(s, d):
    """Gaussian smoothing with holes."""
    return G.gaussian(grid(s, d), 1.5).withColumn("value", F.round("value", 4))


@query(f"""WITH {GRID}, {_KERNEL}, {_FULL}, {_PASS.format(a='grid0', b='g1', x='j', y='i')} SELECT i, j, round(CASE WHEN w >= 1e-3 THEN s / w END, 4) AS value FROM g1""")
def grid_smooth_line(s, d):
    """The same along one axis."""
    return G.gaussian(grid(s, d), 1.5, axes=("j",)).withColumn("value", F.round("value", 4))


@query(f"""WITH {GRID}, a AS (SELECT i, j, coalesce(value, (lag(value) OVER w + lead(value) OVER w) / 2) AS value FROM grid WINDOW w AS (PARTITION BY i ORDER BY j))
SELECT i, j, round(coalesce(value, (lag(value) OVER w + lead(value) OVER w) / 2), 4) AS value FROM a WINDOW w AS (PARTITION BY j ORDER BY i)""")
def grid_fill_gaps(s, d):
    """W7."""
    return G.fill_thin_gaps(grid(s, d).select("i", "j", "value")).withColumn("value", F.round("value", 4))


@query("""WITH a AS (SELECT DISTINCT p_size * 1e0 AS c FROM part), b AS (SELECT c, lead(c) OVER (ORDER BY c) - c AS up, c - lag(c) OVER (ORDER BY c) AS down FROM a)
SELECT c, c - coalesce(down, up) / 2 AS low, c + coalesce(up, down) / 2 AS high FROM b""")
def cell_edges(s, d):
    """Borders of the cells of an axis (a short, distinct list)."""
    return G.edges(table(s, d, "part").select(F.col("p_size").cast("double").alias("c")).distinct(), "c")


@query(f"""WITH {GRID}, t AS (SELECT i, j, 1 AS tile, value * 1e0 AS v FROM grid UNION ALL SELECT i, j, 2, code * 1e0 FROM grid WHERE i >= 25)
SELECT i, j, round(arg_max(CASE WHEN v IS NULL THEN -1 ELSE v END, tile), 4) AS v FROM t GROUP BY i, j""")
def tile_merge(s, d):
    """Overlapping tiles, the last one wins, holes as -1."""
    g = grid(s, d)
    t = g.selectExpr("i", "j", "1 AS tile", "coalesce(value, -1e0) AS v").unionByName(g.where("i >= 25").selectExpr("i", "j", "2 AS tile", "code * 1e0 AS v"))
    return G.merge_tiles(t, ["i", "j"], "tile", "v").withColumn("v", F.round("v", 4))


@query(f"""WITH {GRID}, t AS (SELECT CAST(floor(i / 10) AS INT) AS ti, CAST(floor(j / 10) AS INT) AS tj, min(i) AS min_x, max(i) AS max_x, min(j) AS min_y, max(j) AS max_y FROM grid GROUP BY 1, 2)
SELECT ti, tj FROM t WHERE min_x <= 29 AND max_x >= 12 AND min_y <= 14 AND max_y >= 2""")
def tiles_in_box(s, d):
    """Tiles whose bounds meet a box."""
    g = grid(s, d).groupBy(F.floor(F.col("i") / 10).cast("int").alias("ti"), F.floor(F.col("j") / 10).cast("int").alias("tj"))
    t = g.agg(F.min("i").alias("min_x"), F.max("i").alias("max_x"), F.min("j").alias("min_y"), F.max("j").alias("max_y"))
    return G.tiles_covering(t, 12, 29, 2, 14).select("ti", "tj")


@query(f"WITH {PREDICTIONS}, q AS (SELECT * FROM (VALUES ('1-URGENT', 1.5e0), ('2-HIGH', 1.75e0)) AS t(regime, q)) SELECT row_id, round(sd * coalesce(q, 1.625e0), 6) AS half_width FROM predictions LEFT JOIN q USING (regime)")
def conformal_half_width(s, d):
    """Half-widths by a multiplier of the regime, else the marginal one."""
    q = s.createDataFrame([("1-URGENT", 1.5), ("2-HIGH", 1.75)], "regime string, q double")
    return G.half_width(predictions(s, d), q, "regime", "sd", 1.625, 1.96).select("row_id", F.round("half_width", 6).alias("half_width"))


@query(f"""WITH {GRID}, site AS (SELECT i, j FROM grid ORDER BY (i - 12.3e0) * (i - 12.3e0) + (j - 7.8e0) * (j - 7.8e0), i, j LIMIT 1)
SELECT g.j, g.value FROM grid g JOIN site s ON g.i = s.i""")
def nearest_column(s, d):
    """The raster's line through the cell nearest to a site."""
    g = grid(s, d)
    d2 = F.pow(F.col("i") - 12.3, 2) + F.pow(F.col("j") - 7.8, 2)
    site = g.agg(F.min_by("i", F.struct(d2, "i", "j")).alias("i"))
    return g.join(F.broadcast(site), "i").select("j", "value")


@query(f"""WITH {POINTS}, b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, 20000 / 111320e0 AS dl, 20000 / (111320e0 * cos(radians(min(lat)))) AS dn FROM points),
x AS (SELECT 'lat' AS axis, s - 2 * dl AS first, n + 2 * dl AS last, CAST(round((n - s + 4 * dl) / dl) AS BIGINT) + 1 AS cells FROM b UNION ALL SELECT 'lon', w - 2 * dn, e + 2 * dn, CAST(round((e - w + 4 * dn) / dn) AS BIGINT) + 1 FROM b)
SELECT axis, n, round(first + n * (last - first) / (cells - 1), 9) AS at FROM (SELECT *, unnest(range(cells)) AS n FROM x)""")
def global_axes(s, d):
    """Padded axes of 20 km over the points' box, the step of longitude taken at its southern border."""
    b = points(s, d).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    out = [G.axis(s, *a, "at").select(F.lit(n).alias("axis"), "n", F.round("at", 9).alias("at")) for n, a in zip(("lat", "lon"), G.global_axes(*b, 20_000.0))]
    return out[0].unionByName(out[1])


@query(f"""WITH {POINTS}, b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, 30000 / 111320e0 AS dl FROM points), k AS (SELECT *, dl / cos(radians((s + n) / 2)) AS dn FROM b)
SELECT round(s + i * dl, 9) AS lat, round(w + j * dn, 9) AS lon FROM k, range(0, 400) a(i), range(0, 400) t(j) WHERE s + i * dl <= n + dl / 2 AND w + j * dn <= e + dn / 2""")
def regular_cells(s, d):
    """A regular grid of 30 km, metres turned to degrees at the middle latitude."""
    b = points(s, d).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    return G.regular_cells(s, *b, 30_000.0).select(F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def _tiles(s, d):
    """Two overlapping tiles of the raster: one as it is, one of a coarser, shifted axis; a plane, so that interpolation is exact."""
    g = grid(s, d).where("j < 12")
    plane = F.col("y") * 3 + F.col("x") * 2 + 1
    one = g.select(F.lit(1).alias("tile"), F.col("i").cast("double").alias("y"), F.col("j").cast("double").alias("x")).where("y < 30")
    two = g.where("i % 2 = 0 AND j % 2 = 0").select(F.lit(2).alias("tile"), (F.col("i") + 20.5).alias("y"), F.col("j").cast("double").alias("x"))
    three = g.select(F.lit(3).alias("tile"), (F.col("i") + 60).cast("double").alias("y"), F.col("j").cast("double").alias("x")).where("y < 70")
    return one.unionByName(two).unionByName(three).withColumn("v", plane + F.col("tile") * 1000)


@query(f"""WITH {GRID}, g AS (SELECT CAST(i AS DOUBLE) AS i, CAST(j AS DOUBLE) AS j FROM grid WHERE j < 12),
c AS (SELECT 1 AS tile, i AS y, j AS x FROM g WHERE i < 30 UNION ALL SELECT 2, i + 20.5, j FROM g WHERE i % 2 = 0 AND j % 2 = 0 UNION ALL SELECT 3, i + 60, j FROM g WHERE i + 60 < 70),
b AS (SELECT tile, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM c GROUP BY tile), e AS (SELECT min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1 FROM b),
t AS (SELECT e.y0 + i AS y, e.x0 + j AS x FROM e, range(0, 200) r(i), range(0, 200) q(j) WHERE e.y0 + i <= e.y1 + 0.4 AND e.x0 + j <= e.x1),
k AS (SELECT e.y0 + i * ((e.y1 - e.y0) / round(e.y1 - e.y0)) AS y, e.x0 + j AS x FROM e, range(0, 200) r(i), range(0, 200) q(j) WHERE i <= round(e.y1 - e.y0) AND e.x0 + j <= e.x1)
SELECT round(y, 6) AS y, round(x, 6) AS x, round(arg_max(3 * y + 2 * x + 1 + 1000 * tile, tile), 4) AS v FROM k JOIN b ON k.y BETWEEN b.y0 - 1e-9 AND b.y1 + 1e-9 AND k.x BETWEEN b.x0 AND b.x1 GROUP BY 1, 2""")
def regridded_tiles(s, d):
    """Tiles of different axes on one even grid at the median native spacing, bilinear, the last tile wins."""
    r = G.regrid(_tiles(s, d), "tile", "y", "x", "v")
    return r.select(F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), F.round("v", 4).alias("v"))


@query(f"""WITH {GRID}, c AS (SELECT i * 1e0 AS y, j * 1e0 AS x, k AS depth, coalesce(value, 0) + k AS v FROM grid, (VALUES (1), (2), (5)) AS t(k)),
l AS (SELECT x, depth, 0.7e0 * max(v) FILTER (WHERE y = 12) + 0.3e0 * max(v) FILTER (WHERE y = 13) AS v FROM c WHERE y IN (12, 13) GROUP BY x, depth),
p AS (SELECT 0.4e0 + n * ((20 - 0.4e0) / 39) AS x FROM range(0, 40) r(n)),
near AS (SELECT p.x, arg_min(l.x, abs(l.x - p.x) + l.x * 1e-12) AS at FROM p, (SELECT DISTINCT x FROM l) l GROUP BY p.x)
SELECT round(near.x, 6) AS x, depth, round(v, 4) AS v FROM near JOIN l ON l.x = near.at""")
def transect(s, d):
    """A section along y = 12.3: linear in y, the nearest column in x."""
    c = grid(s, d).select((F.col("i") * 1.0).alias("y"), (F.col("j") * 1.0).alias("x"), F.explode(F.array(*map(F.lit, (1, 2, 5)))).alias("depth"), F.coalesce("value", F.lit(0.0)).alias("v"))
    t = G.transect(c.withColumn("v", F.col("v") + F.col("depth")), "y", "x", "depth", "v", 12.3, 0.4, 20.0, 40)
    return t.select(F.round("x", 6).alias("x"), "depth", F.round("v", 4).alias("v"))


@query(f"""WITH {POINTS}, n AS (SELECT code, sqrt(pow((lon - 135) * cos(radians(35e0)) * 111.32e0, 2) + pow((lat - 35) * 110.574e0, 2)) AS dist, id FROM points),
k AS (SELECT code FROM n WHERE dist <= 200 ORDER BY dist, id LIMIT 8) SELECT code FROM k GROUP BY code ORDER BY count(*) DESC, code LIMIT 1""")
def site_code(s, d):
    """The plurality code of the eight points nearest to one site, within 200 km."""
    return spatial.site_code(points(s, d), "code", 35.0, 135.0)
