"""Queries over filters, projections, encodings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corelog.functions import encode as E
from corelog.queries.inputs import EVENTS, POINTS, PREDICTIONS, events, points, predictions
from corelog.registry import query, table


@query("""SELECT c_custkey, c_acctbal, c_acctbal - 100 AS lowered, CAST(c_nationkey AS SMALLINT) AS code, 0e0 AS elevation FROM customer
WHERE c_acctbal IS NOT NULL AND c_acctbal > -900 AND c_acctbal < 9000 AND c_nationkey BETWEEN 2 AND 20""")
def range_filters(s, d):
    """NULLs out, open and closed ranges, a derived and a defaulted column, casts; all pushed to the scan."""
    c = E.with_default(table(s, d, "customer"), "elevation", 0.0).dropna(subset=["c_acctbal", "c_nationkey"])
    return c.where("c_acctbal > -900 AND c_acctbal < 9000 AND c_nationkey BETWEEN 2 AND 20").select("c_custkey", "c_acctbal", (F.col("c_acctbal") - 100).alias("lowered"), F.col("c_nationkey").cast("smallint").alias("code"), "elevation")


@query(f"WITH {POINTS} SELECT id, CASE WHEN lat > 34.5e0 AND lat < 36.5e0 THEN 'slice' ELSE 'rest' END AS part FROM points WHERE lat BETWEEN 33 AND 37 AND lon BETWEEN 131 AND 138")
def box_filter(s, d):
    """a closed box, an open slice."""
    p = points(s, d).where("lat BETWEEN 33 AND 37 AND lon BETWEEN 131 AND 138")
    return p.select("id", F.when((F.col("lat") > 34.5) & (F.col("lat") < 36.5), "slice").otherwise("rest").alias("part"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 200 AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 20)")
def frequent_sources(s, d):
    """documents long enough, of sources frequent enough."""
    docs = table(s, d, "documents")
    n = docs.groupBy("source").agg(F.count("*").alias("n")).where("n >= 20").select("source")
    return docs.where(F.length("text") >= 200).join(n, "source", "left_semi").select("doc_id", "n_chars")


@query(f"WITH {PREDICTIONS}, x AS (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE ln(y) END AS a, sqrt(sd) AS b FROM predictions) SELECT row_id, round(a + b, 6) AS total FROM x WHERE a IS NOT NULL AND isfinite(a) AND isfinite(b)")
def finite_rows(s, d):
    """rows whose columns are all finite."""
    x = predictions(s, d).selectExpr("row_id", "CASE WHEN row_id % 7 <> 0 THEN ln(y) END AS a", "sqrt(sd) AS b")
    return x.where(E.finite("a", "b")).select("row_id", F.round(F.col("a") + F.col("b"), 6).alias("total"))


@query("""SELECT c_custkey, list_transform(range(0, 12), lambda i: CASE WHEN i = least(11, greatest(0, coalesce(c_nationkey, 11))) THEN 1 ELSE 0 END) AS hot FROM customer""")
def one_hot_fixed(s, d):
    """a fixed width; codes beyond it fall in the last place."""
    return table(s, d, "customer").select("c_custkey", E.one_hot(F.col("c_nationkey"), 12).alias("hot"))


@query("""SELECT o_custkey, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS "1-URGENT", CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS "2-HIGH",
CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS "3-MEDIUM", CAST(sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS BIGINT) AS "4-NOT SPECIFIED",
CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS "5-LOW" FROM orders GROUP BY o_custkey""")
def one_hot_dynamic(s, d):
    """F16: as many columns as values, by a pivot with counts."""
    return table(s, d, "orders").groupBy("o_custkey").pivot("o_orderpriority").count().na.fill(0)


@query("""SELECT doc_id, CAST(contains(lower(text), 'data') AS INT) AS kw_data, CAST(contains(lower(text), 'water') AS INT) AS kw_water, CAST(contains(lower(text), 'license') AS INT) AS kw_license FROM documents""")
def keyword_flags(s, d):
    """one flag a keyword."""
    return table(s, d, "documents").select("doc_id", *E.keyword_flags(F.lower("text"), ["data", "water", "license"]))


@query("""SELECT o_orderkey, coalesce(quality, 0) AS quality, quality IS NOT NULL AS has_quality FROM orders LEFT JOIN labels ON o_orderkey = doc_id""")
def null_fill_flags(s, d):
    """missing values as 0 beside a flag."""
    j = table(s, d, "orders").join(table(s, d, "labels"), F.col("o_orderkey") == F.col("doc_id"), "left")
    return j.select("o_orderkey", *E.fill_flag("quality", 0))


@query(f"""WITH {EVENTS} SELECT event_id, 'click' AS part FROM ev WHERE event_type = 'click' UNION ALL SELECT event_id, 'high' FROM ev WHERE value > 90""")
def union_rows(s, d):
    """Rows of both inputs, repeated ones included."""
    e = events(s, d)
    return e.where("event_type = 'click'").selectExpr("event_id", "'click' AS part").unionByName(e.where("value > 90").selectExpr("event_id", "'high' AS part"))


_SETS = "a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40)"


def _sets(s, d):
    x = table(s, d, "lineitem")
    return x.where("l_returnflag = 'R'").selectExpr("l_partkey AS k"), x.where("l_quantity > 40").selectExpr("l_partkey AS k")


@query(f"WITH {_SETS} SELECT k, 'a only' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'b only' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def except_both_ways(s, d):
    """U3."""
    a, b = _sets(s, d)
    return a.subtract(b).withColumn("side", F.lit("a only")).unionByName(b.subtract(a).withColumn("side", F.lit("b only")))


@query(f"WITH {_SETS} SELECT k FROM a INTERSECT SELECT k FROM b")
def intersect_keys(s, d):
    """U4."""
    a, b = _sets(s, d)
    return a.intersect(b)


@query(f"WITH {_SETS} SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)) AS a_surplus, (SELECT count(*) FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)) AS b_surplus")
def multiset_difference(s, d):
    """Rows that either has more often, counted in one aggregation instead of two differences."""
    a, b = _sets(s, d)
    n = a.withColumn("w", F.lit(1)).unionByName(b.withColumn("w", F.lit(-1))).groupBy("k").agg(F.sum("w").alias("w"))
    return n.agg(F.sum(F.greatest(F.col("w"), F.lit(0))).alias("a_surplus"), F.sum(F.greatest(-F.col("w"), F.lit(0))).alias("b_surplus"))


@query("SELECT vec_id, embedding || [CAST(label AS FLOAT)] AS features FROM embeddings")
def hstack_features(s, d):
    """Feature blocks of one row side by side."""
    return table(s, d, "embeddings").select("vec_id", F.concat("embedding", F.array(F.col("label").cast("float"))).alias("features"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, coalesce(CAST(props->>'$.missing' AS BIGINT), -1) AS missing FROM events""")
def json_extract(s, d):
    """A field of nested JSON with a fallback, by a declared schema."""
    j = F.from_json("props", "k bigint, missing bigint")
    return table(s, d, "events").select("event_id", j["k"].alias("k"), F.coalesce(j["missing"], F.lit(-1)).cast("bigint").alias("missing"))


@query("""WITH j AS (SELECT o_custkey, list({'fold': o_orderkey, 'rmse': o_totalprice} ORDER BY o_orderkey) AS folds FROM orders GROUP BY o_custkey)
SELECT o_custkey, folds[1].rmse AS first_rmse, round(list_avg(list_transform(folds, lambda x: x.rmse)), 6) AS mean_rmse, 8.5e0 AS fallback FROM j""")
def json_folds(s, d):
    """The first and the mean of an array of structs inside JSON, and a constant where the field is missing."""
    j = table(s, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("fold"), F.col("o_totalprice").alias("rmse")))).alias("kfold")).alias("summary"))).alias("text"))
    x = F.from_json("text", "summary struct<kfold: array<struct<fold: bigint, rmse: double>>, other: struct<rmse: double>>")
    folds = x["summary"]["kfold"]
    mean = F.aggregate(folds, F.lit(0.0), lambda a, v: a + v["rmse"]) / F.size(folds)
    return j.select("o_custkey", folds[0]["rmse"].alias("first_rmse"), F.round(mean, 6).alias("mean_rmse"), F.coalesce(x["summary"]["other"]["rmse"], F.lit(8.5)).alias("fallback"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS a, o_orderkey // 4 AS b FROM orders UNION SELECT o_custkey, o_custkey // 3 FROM orders),
r(node) AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r""")
def reachable(s, d):
    """Transitive closure from a set of roots, to a fixpoint, over a sparse graph with as many edges as the table has rows."""
    from corelog.operators.closure import reachable as reach

    o = table(s, d, "orders")
    e = o.selectExpr("o_orderkey AS a", "o_orderkey DIV 4 AS b").unionByName(o.selectExpr("o_custkey AS a", "o_custkey DIV 3 AS b")).distinct()
    return reach(e, "a", "b", o.where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS node"))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def shard_duplicates(s, d):
    """Keys that stand more than once."""
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key")).where("n > 1")


@query("""SELECT o_orderkey, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_priority, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders""")
def restored_order(s, d):
    """Rows keep their id through windows; order matters at the sink alone."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.first("o_orderpriority").over(w).alias("first_priority"), (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("step"))
