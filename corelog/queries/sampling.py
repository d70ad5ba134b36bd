"""Queries over hashed samples and permutations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corelog.operators import sampling as S
from corelog.queries.inputs import EVENTS, PREDICTIONS, events, predictions
from corelog.registry import query, table


@query(f"""WITH {PREDICTIONS}, e AS (SELECT regime, unit, row_number() OVER (PARTITION BY regime ORDER BY md5('5|' || unit), unit) AS r FROM (SELECT DISTINCT regime, unit FROM predictions))
SELECT p.row_id, p.regime, p.unit FROM predictions p JOIN e ON p.regime = e.regime AND p.unit = e.unit AND r <= 40""")
def stratified_entities(s, d):
    """T5: all rows of 40 units of each regime (a sampling operator)."""
    return S.per_stratum(predictions(s, d), "unit", ["regime"], 40, 5).select("row_id", "regime", "unit")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('3|' || o_orderkey), o_orderkey LIMIT 500")
def uniform_sample(s, d):
    """500 rows without replacement (a sampling operator)."""
    return S.exactly(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 3)


@query(f"""WITH {PREDICTIONS} SELECT row_id, unit, CAST('0x' || md5('9|' || unit)[:8] AS BIGINT) < CAST(floor(0.2e0 * 4294967296) AS BIGINT) AS held FROM predictions""")
def atomic_holdout(s, d):
    """A fifth of the units, whole."""
    p = predictions(s, d)
    return p.select("row_id", "unit", S.fraction(p, "unit", 0.2, 9).alias("held"))


@query(f"""WITH {PREDICTIONS}, z AS (SELECT regime, count(*) AS c FROM predictions GROUP BY 1), q AS (SELECT regime, c, round(2000 * (c * pow(1e0 / c, 0.5e0)) / sum(c * pow(1e0 / c, 0.5e0)) OVER (), 6) AS q FROM z),
r AS (SELECT row_id, p.regime, q, c, row_number() OVER (PARTITION BY p.regime ORDER BY md5('11|' || row_id), row_id) AS r FROM predictions p JOIN q USING (regime)),
k AS (SELECT row_id, regime, CAST(floor(r * q / c + 1e-9) - floor((r - 1) * q / c + 1e-9) AS BIGINT) AS copies FROM r) SELECT * FROM k WHERE copies > 0""")
def balanced_draws(s, d):
    """2,000 draws with weights that temper the regimes (a sampling operator)."""
    return S.balanced(predictions(s, d), "row_id", "regime", 2000, 0.5, 11).select("row_id", "regime", "copies")


@query("""WITH x AS (SELECT vec_id, label, CASE WHEN vec_id % 10 <> 3 THEN embedding END AS embedding FROM embeddings),
h AS (SELECT *, embedding IS NULL AS none, row_number() OVER (PARTITION BY label, embedding IS NULL ORDER BY md5('13|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label, embedding IS NULL) AS n FROM x)
SELECT a.vec_id, a.label, b.embedding, b.vec_id AS donor FROM h a JOIN h b ON a.label = b.label AND a.none = b.none AND b.r = a.r % a.n + 1""")
def shuffled_embeddings(s, d):
    """Embeddings permuted inside their label; rows without one (a tenth here) only among themselves."""
    e = table(s, d, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 10 != 3, F.col("embedding")).alias("embedding"), F.col("vec_id").alias("donor"))
    return S.permuted(e.withColumn("none", F.col("embedding").isNull()), "vec_id", ["label", "none"], ["embedding", "donor"], 13).drop("none")


_BLOCKS = f"""{EVENTS}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS len, user_id % 3 AS st, md5('17|' || user_id) AS h FROM ev),
g AS (SELECT user_id, count(*) OVER (PARTITION BY st, len) AS peers FROM (SELECT DISTINCT user_id, st, len FROM r)),
b AS (SELECT r.*, peers > 1 AS block, CASE WHEN peers > 1 THEN len ELSE -1 END AS bl FROM r JOIN g USING (user_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY st, bl, k ORDER BY h, user_id) AS i, count(*) OVER (PARTITION BY st, bl, k) AS n FROM b),
m AS (SELECT a.event_id, c.event_id AS donor, a.block FROM o a JOIN o c ON a.st = c.st AND a.bl = c.bl AND a.k = c.k AND c.i = a.i % a.n + 1)"""


def _moved(s, d):
    e = events(s, d).withColumn("st", (F.col("user_id") % 3).cast("string"))
    return S.block_permutation(e, "event_id", "user_id", "pos", "st", 17)


@query(f"WITH {_BLOCKS} SELECT event_id, donor FROM m")
def block_permutation(s, d):
    """Whole users' rows go to users of the same length and stratum; a bijection."""
    return _moved(s, d).select("event_id", "donor")


@query(f"""WITH {_BLOCKS} SELECT count(*) AS n_rows, count(DISTINCT donor) = count(*) AS is_bijection, round(avg(CASE WHEN block THEN 1 ELSE 0 END), 6) AS by_block,
round(avg(CASE WHEN NOT block AND event_id <> donor THEN 1 ELSE 0 END), 6) AS by_rank, round(avg(CASE WHEN event_id = donor THEN 1 ELSE 0 END), 6) AS kept FROM m""")
def block_permutation_report(s, d):
    """T12's diagnostics."""
    return S.permutation_report(_moved(s, d), "event_id")


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS len FROM ev),
g AS (SELECT user_id, len, row_number() OVER (ORDER BY md5('19|' || user_id), user_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id, len FROM r)),
m AS (SELECT a.user_id, b.user_id AS giver, b.len FROM g a JOIN g b ON b.i = a.i % a.n + 1)
SELECT r.event_id, x.event_id AS donor FROM r JOIN m USING (user_id) JOIN r x ON x.user_id = m.giver AND x.k = least(r.k, m.len)""")
def clipped_permutation(s, d):
    """The older rule, whose donors repeat."""
    return S.clipped_permutation(events(s, d), "event_id", "user_id", "pos", 19)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 2")
def last_two_per_key(s, d):
    """The first rows of each key in an order."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("place")).where("place <= 2")


@query("""WITH r AS (SELECT round(l_extendedprice, -2) AS k, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY round(l_extendedprice, -2) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
SELECT k, l_orderkey, l_linenumber, l_partkey FROM r WHERE r = 1""")
def distinct_rounded(s, d):
    """One row of each rounded key, as a combined minimum, without a sort."""
    t = table(s, d, "lineitem").withColumn("k", F.round("l_extendedprice", -2))
    return t.groupBy("k").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("m")).select("k", "m.l_orderkey", "m.l_linenumber", "m.l_partkey")


@query(f"""WITH {PREDICTIONS}, z AS (SELECT CASE WHEN unit % 50 = 0 THEN 'rare' ELSE regime END AS g, * FROM predictions), b AS (SELECT g, count(*) AS n FROM z GROUP BY 1),
r0 AS (SELECT g, n, CAST(round_even(9000 * sqrt(n) / sum(sqrt(n)) OVER (), 0) AS BIGINT) AS k FROM b),
r1 AS (SELECT g, n, least(n, k + CASE WHEN row_number() OVER (ORDER BY g) = 1 THEN 9000 - sum(k) OVER () ELSE 0 END) AS k FROM r0),
r2 AS (SELECT g, n, k, greatest(0, 9000 - sum(k) OVER ()) AS lacking, coalesce(sum(n - k) OVER (ORDER BY n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r1),
r3 AS (SELECT g, k + greatest(0, least(n - k, lacking - room)) AS k FROM r2),
r AS (SELECT row_id, z.g, k, row_number() OVER (PARTITION BY z.g ORDER BY md5('23|' || row_id), row_id) AS r FROM z JOIN r3 USING (g)) SELECT row_id, g FROM r WHERE r <= k""")
def tempered_budget(s, d):
    """A budget of 9,000 rows by the square roots of the strata's sizes, with rounding repaired and topped up (a sampling operator)."""
    p = predictions(s, d).withColumn("g", F.when(F.col("unit") % 50 == 0, "rare").otherwise(F.col("regime")))
    return S.budget_sample(p, "row_id", "g", 9000, 23).select("row_id", "g")


@query(None)
def seeded_centres(s, d):
    """24 vectors by k-means++ seeding (iterative; tested against a plain loop)."""
    return S.seeded_centres(table(s, d, "embeddings"), "vec_id", "embedding", 24, 41).select("place", "vec_id")
