"""Queries over meshes, neighbours, lines and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelog.functions import mesh
from corelog.operators import spatial
from corelog.queries.inputs import POINTS, points
from corelog.registry import query

_PLANE = f"{POINTS}, p AS (SELECT *, lon * (cos(radians(35e0)) * 111.32e0) AS x, lat * 110.574e0 AS y FROM points)"


def _plane(s, d):
    return spatial.planar(points(s, d), "lat", "lon", 35.0)


_A, _B = "CAST(floor(lat / (2e0 / 3)) AS INT)", "CAST(floor(lon) - 100 AS INT)"
_ROW, _COL = f"CAST(greatest(0, least(7, floor((lat - {_A} * (2e0 / 3)) / (1e0 / 12)))) AS INT)", f"CAST(greatest(0, least(7, floor((lon - 100 - {_B}) / 0.125e0))) AS INT)"
_MESH = f"m AS (SELECT id, lat, lon, v, {_A} AS a, {_B} AS b, {_ROW} AS r, {_COL} AS c FROM points), codes AS (SELECT *, lpad(CAST(a AS VARCHAR), 2, '0') || lpad(CAST(b AS VARCHAR), 2, '0') || r || c AS code2 FROM m)"


@query(f"""WITH {POINTS}, {_MESH} SELECT id, code2[:4] AS code1, code2, code2
|| CAST(greatest(0, least(9, floor((lat - a * (2e0 / 3) - r * (1e0 / 12)) / (1e0 / 120)))) AS INT) || CAST(greatest(0, least(9, floor((lon - 100 - b - c * 0.125e0) / 0.0125e0))) AS INT) AS code3,
CAST(((a * 100 + b) * 10 + r) * 10 + c AS BIGINT) AS key FROM codes""")
def mesh_codes(s, d):
    """M1, M2: mesh codes of three levels and the numeric key."""
    lat, lon = F.col("lat"), F.col("lon")
    return points(s, d).select("id", *[mesh.mesh_code(lat, lon, k).alias(f"code{k}") for k in (1, 2, 3)], mesh.mesh_key(lat, lon).alias("key"))


@query(f"""WITH {POINTS}, {_MESH} SELECT code2, count(*) AS n, round(max(a * (2e0 / 3) + r * (1e0 / 12)), 9) AS south, round(max(100 + b + c * 0.125e0), 9) AS west,
round(max(a * (2e0 / 3) + r * (1e0 / 12) + 1e0 / 12), 9) AS north, round(max(100 + b + c * 0.125e0 + 0.125e0), 9) AS east FROM codes GROUP BY code2""")
def mesh_extent(s, d):
    """M3: bounds of each occupied mesh."""
    g = points(s, d).groupBy(mesh.mesh_code(F.col("lat"), F.col("lon")).alias("code2")).agg(F.count("*").alias("n"))
    b = g.select("code2", "n", *mesh.mesh_bounds(F.col("code2")))
    return b.select("code2", "n", *[F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")])


@query(f"""WITH {POINTS}, {_MESH}, test AS (SELECT DISTINCT a * 8 + r AS y, b * 8 + c AS x FROM codes WHERE id % 10 = 0)
SELECT id FROM codes k WHERE id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM test t WHERE abs(t.y - (k.a * 8 + k.r)) <= 1 AND abs(t.x - (k.b * 8 + k.c)) <= 1)""")
def buffered_training(s, d):
    """Training points in no test mesh nor beside one: neighbours explode, then an anti-join."""
    p = points(s, d).withColumn("mesh", mesh.mesh_code(F.col("lat"), F.col("lon")))
    test = p.where("id % 10 = 0").select("mesh").distinct()
    shut = test.select(F.explode(F.concat(F.array("mesh"), mesh.mesh_neighbours(F.col("mesh")))).alias("mesh")).distinct()
    return p.where("id % 10 <> 0").join(shut, "mesh", "left_anti").select("id")


_PAIRS = "pairs AS (SELECT q.id, c.id AS cid, c.v, c.code, q.code AS own, sqrt((q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y)) AS dist FROM p q JOIN p c ON q.id <> c.id)"


@query(f"""WITH {_PLANE}, {_PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS r FROM pairs WHERE dist < 12)
SELECT p.id, round(b.dist, 6) AS distance, b.v AS near_v FROM p LEFT JOIN b ON p.id = b.id AND b.r = 1""")
def nearest_within(s, d):
    """The nearest other point's value, NULL from 12 km on."""
    p = _plane(s, d)
    return spatial.nearest(p, p, "id", ["v"], 12.0, others=True).select("id", F.round("distance", 6).alias("distance"), "near_v")


@query(f"""WITH {_PLANE}, {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS r FROM pairs WHERE dist <= 40), t AS (SELECT * FROM k WHERE r <= 8),
i AS (SELECT id, sum(v / pow(greatest(dist, 1e-12), 2)) / sum(1 / pow(greatest(dist, 1e-12), 2)) AS idw, min(dist) AS nearest FROM t GROUP BY id),
m AS (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, code) AS r FROM t GROUP BY id, code)
SELECT p.id, coalesce(round(idw, 4), -1) AS idw, coalesce(round(nearest, 6), -1) AS nearest, coalesce(m.code, -1) AS mode FROM p LEFT JOIN i USING (id) LEFT JOIN m ON p.id = m.id AND m.r = 1""")
def knn_mean_and_vote(s, d):
    """Of eight neighbours within 40 km, the inverse-distance mean and the plurality code; -1 where there is none."""
    p = _plane(s, d)
    k = spatial.knn_within(p, p, "id", ["v", "code"], 8, 40.0, others=True)
    found = spatial.inverse_distance(k, "id", "_v_v").join(spatial.vote(k, "id", "_v_code"), "id").select("id", F.round("idw", 4).alias("idw"), F.round("nearest", 6).alias("nearest"), "mode")
    return spatial.with_fill(p, found, "id", {"idw": -1.0, "nearest": -1.0, "mode": -1})


@query(f"""WITH {_PLANE}, {_PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS r FROM pairs WHERE code <> own)
SELECT id, round(sum(v / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)), 4) AS prior, round(min(dist), 6) AS nearest FROM t WHERE r <= 5 GROUP BY id""")
def knn_prior(s, d):
    """The five nearest training points of other groups, at any distance."""
    p = _plane(s, d)
    k = spatial.knn(p, p, "id", ["v"], 5, 20.0, other="code")
    return spatial.inverse_distance(k, "id", "_v_v", power=1.0, floor=1e-6).select("id", F.round("idw", 4).alias("prior"), F.round("nearest", 6).alias("nearest"))


@query(f"""WITH {_PLANE}, l AS (SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY id) AS x2, lead(y) OVER (ORDER BY id) AS y2 FROM p WHERE id <= 20),
t AS (SELECT p.id, p.x, p.y, l.*, greatest(0, least(1, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS u FROM p, l WHERE x2 IS NOT NULL)
SELECT id, round(sqrt(min((x - x1 - u * (x2 - x1)) * (x - x1 - u * (x2 - x1)) + (y - y1 - u * (y2 - y1)) * (y - y1 - u * (y2 - y1)))), 6) AS distance FROM t GROUP BY id""")
def line_distance(s, d):
    """The distance to a polyline, whose 20 vertices are the reference geometry, not a sample."""
    p = _plane(s, d)
    v = p.where("id <= 20").orderBy("id").select("x", "y").collect()
    seg = s.createDataFrame([(a.x, a.y, b.x, b.y) for a, b in zip(v, v[1:])], "x1 double, y1 double, x2 double, y2 double")
    return spatial.line_distance(p, seg, "id").select("id", F.round("distance", 6).alias("distance"))


_RINGS = [(1, "west", [(130.0, 30.0), (135.0, 31.0), (133.0, 37.0), (130.5, 38.0)]), (2, "east", [(134.0, 31.0), (139.5, 30.5), (139.0, 39.0), (134.5, 36.0)])]


def _inside(ring) -> str:
    edges = [f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < {ax}e0 + (lat - {ay}e0) * ({bx - ax}e0) / ({by - ay}e0) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])]
    return f"({' + '.join(edges)}) % 2 = 1"


@query(f"WITH {POINTS} SELECT id, CASE WHEN {_inside(_RINGS[0][2])} THEN 'west' WHEN {_inside(_RINGS[1][2])} THEN 'east' ELSE 'none' END AS area FROM points")
def point_in_polygon(s, d):
    """The first polygon that holds a point, else 'none'."""
    polygons = s.createDataFrame(_RINGS, "ord int, area string, ring array<struct<x: double, y: double>>")
    return spatial.in_polygon(points(s, d).selectExpr("id", "lon AS x", "lat AS y"), polygons, "id", "ord", "area", "none")


_CENTRES = [("a", 32.0, 132.0), ("b", 38.0, 133.0), ("c", 35.0, 137.0), ("d", 31.0, 139.0)]


@query(f"""WITH {POINTS}, c AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}e0, {b}e0)" for n, a, b in _CENTRES)}) AS t(name, clat, clon)),
near AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY pow(lat - clat, 2) + pow((lon - clon) * cos(radians(lat)), 2), name) AS r FROM points, c)
SELECT p.id, COALESCE(CASE WHEN p.id % 4 = 0 THEN p.seg END, n.name) AS area FROM points p JOIN near n ON p.id = n.id AND n.r = 1""")
def exact_or_nearest_area(s, d):
    """A known point's label, else the nearest centre's."""
    p = points(s, d)
    known = p.where("id % 4 = 0").select("lat", "lon", F.col("seg").alias("known")).distinct()
    centre = spatial.nearest_centre(p, s.createDataFrame(_CENTRES, "name string, clat double, clon double"), "id", "lat", "lon", "name")
    return p.join(known, ["lat", "lon"], "left").join(centre, "id").select("id", F.coalesce("known", "name").alias("area"))
