"""Queries over as-of, interval, alignment and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corelog.operators import joins as J
from corelog.operators.aggregates import share
from corelog.queries.inputs import EVENTS, GRID, LAYERS, POINTS, PURCHASES, events, grid, layers, points, purchases
from corelog.registry import query, table

_ASOF = f"""WITH {EVENTS}, {LAYERS}, {PURCHASES},
hit AS (SELECT p.*, CASE WHEN p.pos < l.bottom THEN l.layer_id END AS layer_id
  FROM purchases p ASOF LEFT JOIN layers l ON p.user_id = l.user_id AND p.pos >= l.top)"""


def _asof(s, d):
    return J.asof_interval(purchases(s, d), layers(s, d), ["user_id"], "pos", "top", "bottom", ["layer_id"])


@query(f"{_ASOF} SELECT event_id, user_id, layer_id FROM hit")
def asof_purchase_to_signup(s, d):
    """Each purchase's active interval, by one shuffle and a window."""
    return _asof(s, d).select("event_id", "user_id", "layer_id")


_COARSE = f"""WITH {EVENTS}, {LAYERS}, {PURCHASES},
ranked AS (SELECT user_id % 50 AS k, user_id, layer_id, top, bottom, row_number() OVER (PARTITION BY user_id % 50, top ORDER BY layer_id DESC) AS r FROM layers),
fine AS (SELECT p.event_id, CASE WHEN p.pos < l.bottom THEN l.layer_id END AS layer_id, CASE WHEN p.pos < l.bottom THEN l.user_id END AS owner
  FROM purchases p ASOF LEFT JOIN layers l ON p.user_id = l.user_id AND p.pos >= l.top),
coarse AS (SELECT p.event_id, p.user_id, CASE WHEN p.pos < l.bottom THEN l.layer_id END AS layer_id, CASE WHEN p.pos < l.bottom THEN l.user_id END AS owner
  FROM purchases p ASOF LEFT JOIN (SELECT * FROM ranked WHERE r = 1) l ON p.user_id % 50 = l.k AND p.pos >= l.top)"""


def _coarse(s, d):
    left = purchases(s, d).withColumn("k", F.col("user_id") % 50)
    right = layers(s, d).select((F.col("user_id") % 50).alias("k"), F.col("user_id").alias("owner"), "layer_id", "top", "bottom")
    return J.asof_interval(left, right, ["k"], "pos", "top", "bottom", ["layer_id", "owner"], tie="layer_id")


@query(f"{_COARSE} SELECT event_id, layer_id, owner FROM coarse")
def asof_rounded_key(s, d):
    """The same under a coarse key that several groups share."""
    return _coarse(s, d).select("event_id", "layer_id", "owner")


@query(f"""{_COARSE} SELECT count(*) AS n_rows, count(f.layer_id) AS n_a, count(c.layer_id) AS n_b,
CAST(sum(CASE WHEN f.layer_id IS NOT NULL AND c.layer_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a,
CAST(sum(CASE WHEN f.layer_id IS NULL AND c.layer_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b,
CAST(sum(CASE WHEN f.layer_id <> c.layer_id THEN 1 ELSE 0 END) AS BIGINT) AS changed,
CAST(sum(CASE WHEN f.owner <> c.user_id THEN 1 ELSE 0 END) AS BIGINT) AS foreign_a,
CAST(sum(CASE WHEN c.owner <> c.user_id THEN 1 ELSE 0 END) AS BIGINT) AS foreign_b
FROM fine f JOIN coarse c USING (event_id)""")
def asof_join_delta(s, d):
    """How the two joins differ: rates, changed labels, matches of another owner."""
    right = layers(s, d).withColumn("owner", F.col("user_id"))
    fine = J.asof_interval(purchases(s, d), right, ["user_id"], "pos", "top", "bottom", ["layer_id", "owner"])
    return J.join_delta(purchases(s, d).withColumn("owner", F.col("user_id")), fine, _coarse(s, d), "event_id", "layer_id", "owner")


@query(f"""WITH {EVENTS}, {LAYERS}, {PURCHASES},
hit AS (SELECT p.pos, l.top, l.bottom FROM purchases p ASOF JOIN layers l ON p.user_id = l.user_id AND p.pos >= l.top WHERE p.pos < l.bottom)
SELECT eps_h, count(*) AS n, round(avg(CASE WHEN least(pos - top, bottom - pos) < eps_h * 3600000000 THEN 1 ELSE 0 END), 9) AS near
FROM hit, (VALUES (1), (6), (12)) AS e(eps_h) GROUP BY eps_h""")
def boundary_sensitivity(s, d):
    """A5: the share of matches within 1, 6 and 12 hours of an interval's edge."""
    hit = J.asof_interval(purchases(s, d), layers(s, d).withColumns({"top_": F.col("top"), "bottom_": F.col("bottom")}), ["user_id"], "pos", "top", "bottom", ["top_", "bottom_"]).where("top_ IS NOT NULL")
    near = F.least(F.col("pos") - F.col("top_"), F.col("bottom_") - F.col("pos")) < F.col("eps_h").cast("bigint") * 3600000000
    return hit.withColumn("eps_h", F.explode(F.array(*map(F.lit, (1, 6, 12))))).groupBy("eps_h").agg(F.count("*").alias("n"), F.round(share(near), 9).alias("near"))


@query(f"""WITH {EVENTS}, {LAYERS}, {PURCHASES}
SELECT event_id, layer_id FROM (SELECT p.event_id, l.layer_id, row_number() OVER (PARTITION BY p.event_id ORDER BY l.layer_id) AS r
FROM purchases p JOIN layers l ON p.user_id = l.user_id AND l.top <= p.pos AND p.pos < l.bottom) WHERE r = 1""")
def interval_first(s, d):
    """Each purchase's first covering interval, by the interval's number; uncovered ones are left out."""
    return J.first_containing(purchases(s, d), layers(s, d), ["user_id"], "pos", "top", "bottom", "layer_id", ["layer_id"]).select("event_id", "layer_id")


@query(f"""WITH {EVENTS}, {LAYERS}, {PURCHASES} SELECT event_id, user_id FROM purchases p
WHERE EXISTS (SELECT 1 FROM layers l WHERE l.user_id = p.user_id AND p.pos BETWEEN l.top AND l.bottom)""")
def interval_cover(s, d):
    """Purchases that any closed interval covers, by a running greatest end."""
    return J.interval_exists(purchases(s, d), layers(s, d), ["user_id"], "pos", "top", "bottom").select("event_id", "user_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(p_retailprice * 2 + p_size, 6) AS derived FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def distinct_key_enrich(s, d):
    """What depends on the part alone is derived once a part, then joined back."""
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.round(F.col("p_retailprice") * 2 + F.col("p_size"), 6).alias("derived"))
    return J.distinct_enrich(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], lambda k: k.join(part, "l_partkey", "left"))


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def many_to_one_join(s, d):
    """A left join whose right side is checked to be unique."""
    right = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.many_to_one(table(s, d, "orders").select("o_orderkey", "o_custkey"), right, ["o_custkey"])


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_KEYS = ["l_orderkey", "l_linenumber"]


@query(f"""WITH a AS (SELECT {_LINE}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate) AS nth FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_quantity, CAST(b.l_shipdate AS VARCHAR)[:10] AS shipped FROM a LEFT JOIN b USING (l_orderkey, l_linenumber, nth)""")
def multiset_alignment(s, d):
    """Repeated keys align one to one by their place in the key; a row without partner would stop the job."""
    left = table(s, d, "lineitem").select(*_LINE.split(", "))
    right = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").withColumn("shipped", F.substring(F.col("l_shipdate").cast("string"), 1, 10))
    out = J.multiset_align(left, right, _KEYS, ["shipped"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["l_shipdate"], strict=True)
    return out.select(*_KEYS, "l_partkey", "l_quantity", "shipped")


@query(f"""WITH {POINTS}, cache AS (SELECT round(lat, 1) AS k1, round(lon, 1) AS k2, min(v) AS cached FROM points WHERE id % 3 = 0 GROUP BY 1, 2)
SELECT id, cached FROM points LEFT JOIN cache ON round(lat, 1) = k1 AND round(lon, 1) = k2""")
def rounded_key_cache(s, d):
    """The least cached value of the point's rounded coordinates."""
    p = points(s, d)
    keys = [J.rounded("lat", 1), J.rounded("lon", 1)]
    return J.aggregate_then_join(p, p.where("id % 3 = 0"), keys, keys, "v", "cached").select("id", "cached")


@query(f"""WITH {EVENTS} SELECT * FROM ev WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM ev WHERE value > 80)""")
def semi_membership(s, d):
    """Rows whose composite key stands in another table."""
    e = events(s, d)
    return e.join(e.where("value > 80").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_semi").select(e.columns)


@query("""SELECT event_id, COALESCE(code, 7) AS code FROM events LEFT JOIN (VALUES ('click', 0), ('view', 1), ('purchase', 2)) AS t(event_type, code) USING (event_type)""")
def code_lookup(s, d):
    """A code table's value, or the default code 7."""
    codes = s.createDataFrame([("click", 0), ("view", 1), ("purchase", 2)], "event_type string, code int")
    return J.lookup(events(s, d), codes, "event_type", "code", 7).select("event_id", "code")


@query(f"""WITH {POINTS} SELECT id, 30 + greatest(0, least(19, ceil((lat - 30) / 0.5e0 - 0.5))) * 0.5e0 AS snapped FROM points""")
def axis_snap(s, d):
    """The nearest of 20 axis values; ties go left."""
    return points(s, d).select("id", J.snap_to_axis(F.col("lat"), 30.0, 0.5, 20).alias("snapped"))


_AXES = {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0, "nx": 50, "ny": 25}
_AT = "at0 AS (SELECT id, (lat - 30) * 6e0 AS x, (lon - 130) * 4e0 AS y FROM points)"


def _at(s, d):
    return points(s, d).selectExpr("id", "(lat - 30) * 6e0 AS x", "(lon - 130) * 4e0 AS y")


@query(f"""WITH {POINTS}, {GRID}, {_AT}, f AS (SELECT id, x, y, least(floor(x), 48) AS i0, least(floor(y), 23) AS j0, x BETWEEN 0 AND 49 AND y BETWEEN 0 AND 24 AS inside FROM at0),
c AS (SELECT f.id, count(g.value) AS n, sum(g.value * CASE WHEN g.i = i0 THEN 1 - x + i0 ELSE x - i0 END * CASE WHEN g.j = j0 THEN 1 - y + j0 ELSE y - j0 END) AS t
  FROM f LEFT JOIN grid g ON inside AND g.i IN (i0, i0 + 1) AND g.j IN (j0, j0 + 1) GROUP BY f.id)
SELECT id, round(CASE WHEN n = 4 THEN t ELSE -1 END, 4) AS sample FROM c""")
def raster_bilinear(s, d):
    """A raster between its cells; -1 outside or beside a hole."""
    return J.raster_bilinear(_at(s, d), grid(s, d), "x", "y", fill=-1.0, **_AXES).select("id", F.round("sample", 4).alias("sample"))


@query(f"""WITH {POINTS}, {GRID}, {_AT} SELECT id, COALESCE(g.value, -1) AS sample FROM at0 LEFT JOIN grid g
ON x BETWEEN 0 AND 49 AND y BETWEEN 0 AND 24 AND g.i = floor(x + 0.5) AND g.j = floor(y + 0.5)""")
def raster_nearest(s, d):
    """The nearest cell's value; -1 outside or in a hole."""
    return J.raster_nearest(_at(s, d), grid(s, d), "x", "y", fill=-1.0, **_AXES).select("id", "sample")
