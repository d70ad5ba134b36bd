"""Queries over folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelog.functions import mesh
from corelog.operators import folds as P
from corelog.queries.inputs import POINTS, PREDICTIONS, points, predictions
from corelog.registry import query, table

_BOXES = [("north", 36.0, 40.0, 130.0, 140.0), ("mid", 33.0, 37.0, 131.0, 138.0), ("south", 30.0, 34.0, 130.0, 136.0)]
_T = "b AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {s}e0, {t}e0, {w}e0, {e}e0)" for i, (n, s, t, w, e) in enumerate(_BOXES)) + ") AS t(o, name, s, n, w, e))"


@query(f"WITH {POINTS}, {_T} SELECT id, name AS fold FROM points JOIN b ON lat BETWEEN s AND n AND lon BETWEEN w AND e")
def region_folds(s, d):
    """Overlapping closed boxes."""
    return P.region_folds(points(s, d), "lat", "lon", _BOXES).select("id", "fold")


@query(f"""WITH {POINTS}, {_T} SELECT DISTINCT id, CASE WHEN name = 'south' THEN 'lower' ELSE 'upper' END AS fold FROM points JOIN b ON lat BETWEEN s AND n AND lon BETWEEN w AND e""")
def block_folds(s, d):
    """Unions of boxes."""
    return P.block_folds(points(s, d), "lat", "lon", _BOXES, {"upper": ["north", "mid"], "lower": ["south"]}).select("id", "fold")


@query(f"""WITH {POINTS}, {_T} SELECT id, (SELECT arg_min(name, o) FROM b WHERE lat BETWEEN s AND n AND lon BETWEEN w AND e) AS first_box,
(SELECT arg_max(name, o) FROM b WHERE lat >= s AND lat < n AND lon >= w AND lon < e) AS last_box FROM points""")
def region_labels(s, d):
    """The first closed and the last half-open box."""
    lat, lon = F.col("lat"), F.col("lon")
    return points(s, d).select("id", P.first_region(lat, lon, _BOXES).alias("first_box"), P.last_region(lat, lon, _BOXES).alias("last_box"))


@query(None)
def greedy_mesh_folds(s, d):
    """P5: whole meshes to the least loaded of five folds (iterative; tested by a plain loop)."""
    p = points(s, d).withColumn("cell", mesh.mesh_code(F.col("lat"), F.col("lon"), 1))
    return P.greedy_folds(p, "cell", 5, 29).select("id", "cell", "fold")


_CELL = "c AS (SELECT *, lpad(CAST(CAST(floor(lat / (2e0 / 3)) AS INT) AS VARCHAR), 2, '0') || lpad(CAST(CAST(floor(lon) - 100 AS INT) AS VARCHAR), 2, '0') AS cell FROM points)"


@query(None)
def contiguous_folds(s, d):
    """Four regions of neighbouring meshes by k-means of their centres (fitted; tested by the regions' compactness)."""
    p = points(s, d).withColumn("cell", mesh.mesh_code(F.col("lat"), F.col("lon")))
    south, west, north, east = mesh.mesh_bounds(F.col("cell"))
    return P.contiguous_folds(p, "cell", (south + north) / 2, (west + east) / 2, 4).select("id", "cell", "fold")


@query(f"""WITH {POINTS}, l AS (SELECT id, CASE code % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS area FROM points)
SELECT id, f.fold, coalesce(area = f.fold, false) AS test FROM l, (SELECT DISTINCT area AS fold FROM l WHERE area IN ('a', 'c')) f""")
def leave_area_out(s, d):
    """Each of two areas held out in turn; points of no area always train."""
    area = F.when(F.col("code") % 5 == 0, "a").when(F.col("code") % 5 == 1, "b").when(F.col("code") % 5 == 2, "c")
    return P.leave_out(points(s, d).select("id", area.alias("area")), "area", ["a", "c", "none"]).select("id", "fold", "test")


@query(f"""WITH {POINTS}, {_CELL}, k AS (SELECT cell, count(*) AS n FROM c GROUP BY cell), r AS (SELECT cell, sum(n) OVER (ORDER BY md5('31|' || cell), cell) - n < 0.3e0 * sum(n) OVER () AS cal FROM k)
SELECT id, cal FROM c JOIN r USING (cell)""")
def disjoint_calibration(s, d):
    """Whole meshes until they hold 30 % of the rows."""
    p = points(s, d).withColumn("cell", mesh.mesh_code(F.col("lat"), F.col("lon"), 1))
    return P.disjoint_split(p, "cell", 0.3, 31).select("id", "cal")


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS test FROM customer")
def category_holdout(s, d):
    """P10."""
    return P.category_holdout(table(s, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "test")


@query("""SELECT p_partkey, CASE WHEN y <= 1979 THEN '<=1979' WHEN y >= 2020 THEN '>=2020' ELSE CAST(CAST(floor(y / 10) * 10 AS INT) AS VARCHAR) || 's' END AS decade FROM (SELECT p_partkey, 1965 + p_partkey % 63 AS y FROM part)""")
def year_bins(s, d):
    """P12."""
    return table(s, d, "part").select("p_partkey", P.year_bin(1965 + F.col("p_partkey") % 63).alias("decade"))


@query("""WITH l AS (SELECT o_custkey AS e, unnest(['priority', 'year', 'clerk']) AS family, unnest([o_orderpriority, CASE WHEN year(o_orderdate) >= 1993 THEN CAST(year(o_orderdate) AS VARCHAR) END, CAST(o_custkey % 37 AS VARCHAR)]) AS fold FROM orders),
g AS (SELECT family, fold, count(DISTINCT e) AS n_entities, count(*) AS n_test FROM l GROUP BY 1, 2), t AS (SELECT *, CAST(sum(n_test) OVER (PARTITION BY family) - n_test AS BIGINT) AS n_train FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n_entities DESC, fold) AS r FROM t WHERE fold IS NOT NULL) SELECT family, fold, n_entities, n_test, n_train FROM r WHERE r <= 4 AND n_test >= 50 AND n_train >= 100""")
def provenance_folds(s, d):
    """Leave-one-label-out folds of three families of labels, the four labels of most customers each."""
    o = table(s, d, "orders")
    year = F.when(F.year("o_orderdate") >= 1993, F.year("o_orderdate"))
    return P.provenance_folds(o, "o_custkey", {"priority": F.col("o_orderpriority"), "year": year, "clerk": F.col("o_custkey") % 37}, top=4)


@query(f"""WITH {PREDICTIONS}, g AS (SELECT unit % 200 AS fold, count(*) AS n_test FROM predictions GROUP BY 1) SELECT * FROM (SELECT *, CAST(sum(n_test) OVER () - n_test AS BIGINT) AS n_train FROM g) WHERE n_test >= 60 AND n_train >= 100""")
def guarded_folds(s, d):
    """Folds with enough rows on either side."""
    return P.guarded_folds(predictions(s, d).withColumn("fold", F.col("unit") % 200), "fold", 60)


@query(f"""WITH {PREDICTIONS}, s AS (SELECT *, regime IN ('1-URGENT', '2-HIGH') AS src FROM predictions), t AS (SELECT unit, row_number() OVER (ORDER BY md5('37|' || unit), unit) AS r FROM (SELECT DISTINCT unit FROM s WHERE NOT src)),
h AS (SELECT *, r > ceil(max(r) OVER () * (1 - 0.3e0)) AS test FROM t), x AS (SELECT s.row_id, b.budget, CASE WHEN src THEN 'train' WHEN test THEN 'test' WHEN r <= budget THEN 'train' END AS part FROM s LEFT JOIN h USING (unit), (VALUES (0), (50), (200)) AS b(budget))
SELECT budget, part, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM x WHERE part IS NOT NULL GROUP BY budget, part""")
def few_shot_budgets(s, d):
    """Source rows and n target units, one common holdout, summed by budget."""
    f = P.few_shot(predictions(s, d), "unit", F.col("regime").isin("1-URGENT", "2-HIGH"), [0, 50, 200], 0.3, 37)
    return f.groupBy("budget", "part").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"""WITH {POINTS}, b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM points),
c AS (SELECT i, j, i * (1e0 / 12) AS south, (i + 1) * (1e0 / 12) AS north, j * 0.125e0 AS west, (j + 1) * 0.125e0 AS east FROM range(0, 600) a(i), range(900, 1300) t(j), b
WHERE i >= floor(s / (1e0 / 12)) AND i < ceil(n / (1e0 / 12)) AND j >= floor(w / 0.125e0) AND j < ceil(e / 0.125e0))
SELECT i, j, round(south, 9) AS south, round(west, 9) AS west, round(south - 5 / 111.32e0, 9) AS halo_south, round(east + 5 / 111.32e0 / greatest(0.1, cos(radians((south + north) / 2))), 9) AS halo_east FROM c""")
def mesh_tiles(s, d):
    """Tiles of ten km over the points' box, aligned to the mesh, each with a halo of five km."""
    b = points(s, d).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    t = P.tiles(s, *b, 10.0, 5.0)
    return t.select("i", "j", *[F.round(c, 9).alias(c) for c in ("south", "west", "halo_south", "halo_east")])
