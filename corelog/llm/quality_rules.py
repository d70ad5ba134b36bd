"""Quality rules with adaptive thresholds (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelog.llm.common import fresh, small, written
from corelog.llm.signals import SIGNALS, SIGNALS_SQL, with_signals

#: Buckets for each factor e: a quantile's relative error is at most 1 / (2 * RESOLUTION), about 1.6 %.
RESOLUTION = 32
#: A text passes where each signal is within the middle half of its group, widened on either side by so many times its width.
WIDTHS = 10
#: To each group's sketch its language's is added with the weight of so many documents, to which that of all documents was
#: added alike: a large group is judged by itself, a small one by its language, with no border between them.
PRIOR = 50

_WHOLE = "decimal(38,0)"


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value of 0 or more: equally wide on a logarithmic scale."""
    return F.floor(F.log(1 + value.cast("double")) * RESOLUTION).cast("int")


def sketch(df: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    """A quantile sketch for each group of keys: rows (keys, bucket, n).

    Two sketches merge by adding up the n of equal buckets, in any order and grouping, so Spark's partial aggregation
    builds and merges them before the shuffle: what moves is groups times buckets, whatever the number of documents.
    NULL values are left out; NULL keys are a group.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias(count))


def _whole(x: Column) -> Column:
    return x.cast(_WHOLE)


def _quartiles(buckets: Column) -> Column:
    """(quartile 1, quartile 3) of array<struct<bucket, n>> in the order of buckets, as values: the first bucket that reaches
    the share, bucket b standing for exp((b + 0.5) / RESOLUTION) - 1. NULL if it is empty."""
    total = F.aggregate(buckets, _whole(F.lit(0)), lambda s, x: _whole(s + x["n"]))

    def at(quarters: int) -> Column:
        state = F.aggregate(
            buckets,
            F.struct(_whole(F.lit(0)).alias("seen"), F.lit(None).cast("int").alias("bucket")),
            lambda s, x: F.struct(
                _whole(s["seen"] + x["n"]).alias("seen"),
                F.when(s["bucket"].isNotNull(), s["bucket"]).when(_whole(s["seen"] + x["n"]) * 4 >= total * quarters, x["bucket"]).alias("bucket"),
            ),
        )
        return F.exp((state["bucket"] + 0.5) / RESOLUTION) - 1

    return F.struct(at(1).alias("q1"), at(3).alias("q3"))


def thresholds(scored: DataFrame, signals: str = "signals") -> DataFrame:
    """(lang, source, signal, low, high): the bounds that each group's quartiles give, one row for each group and signal.

    scored: (lang, source, signals). A group's sketch is shrunk towards its language's, and that towards all documents', by
    PRIOR. low = floor(q1 - WIDTHS * w), high = ceil(q3 + WIDTHS * w), where w is the greatest of q3 - q1, of the same among
    those of the language (shrunk alike) whose signal isn't 0, as most texts have no digit at all, and of the signals'
    resolution 1. NULL lang or source is a group like any other. No documents: no rows.
    """
    long = scored.select("lang", "source", F.posexplode_outer(signals).alias("signal", "value"))  # outer: an inner one adds a filter that computes the signals again
    # One scan, whose small result is written: level 0 is (lang, source), 1 the language, 2 all. The finest one comes first, the others add it up.
    fine = written(sketch(long, ["lang", "source", "signal"], "value"), "sketch")

    def level(keys: list[str], i: int) -> DataFrame:
        summed = fine if i == 0 else fine.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        return summed.groupBy(*keys).agg(_whole(F.sum("n")).alias(f"t{i}"), F.collect_list(F.struct("bucket", _whole(F.col("n")).alias("n"))).alias(f"b{i}"))

    a, b = level(["lang", "source", "signal"], 0).alias("a"), level(["lang", "signal"], 1).alias("b")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.signal") == F.col("b.signal")), "left")
    joined = joined.select("a.*", "b.t1", "b.b1").join(level(["signal"], 2), "signal", "left")
    # Whole numbers throughout: n0 + PRIOR (n1 + PRIOR n2 / t2) / (t1 + PRIOR), times (t1 + PRIOR) t2.
    times = lambda c, f: F.transform(c, lambda x: F.struct(x["bucket"].alias("bucket"), _whole(x["n"] * f).alias("n")))
    prior, square = _whole(F.lit(PRIOR)), _whole(F.lit(PRIOR * PRIOR))
    t1, t2 = F.col("t1"), F.col("t2")
    own = F.array_sort(F.concat(times("b0", _whole(_whole(t1 + prior) * t2)), times("b1", _whole(prior * t2)), times("b2", square)))
    some = F.array_sort(F.filter(F.concat(times("b1", t2), times("b2", prior)), lambda x: x["bucket"] > 0))
    q = joined.select("lang", "source", "signal", own.alias("own"), some.alias("some")).select("lang", "source", "signal", _quartiles(F.col("own")).alias("q"), _quartiles(F.col("some")).alias("s"))
    spread = F.greatest(F.col("q.q3") - F.col("q.q1"), F.coalesce(F.col("s.q3") - F.col("s.q1"), F.lit(0.0)), F.lit(1.0))
    return q.select("lang", "source", "signal", F.floor(F.col("q.q1") - WIDTHS * spread).cast("bigint").alias("low"), F.ceil(F.col("q.q3") + WIDTHS * spread).cast("bigint").alias("high"))


def filter_quality(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of df all of whose signals are within the bounds of their (language, source); df's columns.

    The thresholds come from all rows of df, by mergeable quantile sketches. One scan writes the rows with their signals to
    the shared folder, from where they are sketched and filtered. The thresholds are one row for each (lang, source), written
    once and broadcast if few; more are joined by shuffle.
    NULL text: no signals, so no rule fails and the row stays; an empty text has signals 0, 0, 0, 0, 5000 and is judged by
    them. NULL lang or source is a group of its own. Repeated rows are counted and judged each. Empty table: empty result.
    Extra columns pass through, whatever their names.
    """
    scored, s = with_signals(df, text)
    scored = written(scored, "signals")
    wide = thresholds(scored.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(s).alias("signals")))
    wide = small(written(wide.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("signal", "low", "high"))).alias("bounds")), "bounds"))
    gl, gs, b = fresh(scored, "group_lang", "group_source", "bounds")
    wide = wide.select(F.col("lang").alias(gl), F.col("source").alias(gs), F.col("bounds").alias(b))
    # NULL text has no signal and so passes; its group may lack bounds.
    ok = F.coalesce(F.forall(F.zip_with(F.col(s), F.col(b), lambda v, x: v.between(x["low"], x["high"])), lambda x: x), F.lit(True))
    return scored.join(wide, F.col(lang).eqNullSafe(F.col(gl)) & F.col(source).eqNullSafe(F.col(gs)), "left").where(ok).select(*df.columns)


FILTER_SQL = (
    "WITH "
    + SIGNALS_SQL
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT lang, source, {i} AS signal, {s} AS value FROM signals WHERE text IS NOT NULL" for i, s in enumerate(SIGNALS))
    + f"""), fine AS (
    SELECT lang, source, signal, CAST(floor(ln(1 + value::DOUBLE) * {RESOLUTION}) AS INTEGER) AS bucket, count(*) AS n
    FROM long GROUP BY ALL
), own AS (
    SELECT lang, source, signal, bucket, n, sum(n) OVER (PARTITION BY lang, source, signal) AS t0 FROM fine
), by_lang AS (
    SELECT lang, signal, bucket, sum(n)::HUGEINT AS n FROM fine GROUP BY ALL
), langs AS (
    SELECT *, (sum(n) OVER (PARTITION BY lang, signal))::HUGEINT AS t1 FROM by_lang
), every AS (
    SELECT signal, bucket, sum(n)::HUGEINT AS n, (sum(sum(n)) OVER (PARTITION BY signal))::HUGEINT AS t2 FROM fine GROUP BY signal, bucket
), groups AS (
    SELECT DISTINCT f.lang, f.source, f.signal, l.t1, e.t2 FROM fine f
    JOIN langs l ON l.lang IS NOT DISTINCT FROM f.lang AND l.signal = f.signal JOIN every e ON e.signal = f.signal
), merged AS (
    SELECT g.lang, g.source, g.signal, 0 AS part, o.bucket, o.n::HUGEINT * (g.t1 + {PRIOR}) * g.t2 AS n
    FROM groups g JOIN own o ON o.signal = g.signal AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
    UNION ALL SELECT g.lang, g.source, g.signal, 0, l.bucket, {PRIOR} * l.n * g.t2
    FROM groups g JOIN langs l ON l.signal = g.signal AND l.lang IS NOT DISTINCT FROM g.lang
    UNION ALL SELECT g.lang, g.source, g.signal, 0, e.bucket, {PRIOR * PRIOR} * e.n FROM groups g JOIN every e ON e.signal = g.signal
    UNION ALL SELECT g.lang, g.source, g.signal, 1, l.bucket, l.n * g.t2
    FROM groups g JOIN langs l ON l.signal = g.signal AND l.lang IS NOT DISTINCT FROM g.lang WHERE l.bucket > 0
    UNION ALL SELECT g.lang, g.source, g.signal, 1, e.bucket, {PRIOR} * e.n FROM groups g JOIN every e ON e.signal = g.signal WHERE e.bucket > 0
), summed AS (
    SELECT lang, source, signal, part, bucket, sum(n)::HUGEINT AS n FROM merged GROUP BY ALL
), ranked AS (
    SELECT *, (sum(n) OVER (PARTITION BY lang, source, signal, part ORDER BY bucket))::HUGEINT AS seen, (sum(n) OVER (PARTITION BY lang, source, signal, part))::HUGEINT AS total FROM summed
), quartiles AS (
    SELECT lang, source, signal, part, exp((min(bucket) FILTER (WHERE seen * 4 >= total) + 0.5) / {RESOLUTION}) - 1 AS q1,
           exp((min(bucket) FILTER (WHERE seen * 4 >= total * 3) + 0.5) / {RESOLUTION}) - 1 AS q3
    FROM ranked GROUP BY ALL
), spread AS (
    SELECT lang, source, signal, max(q1) FILTER (WHERE part = 0) AS q1, max(q3) FILTER (WHERE part = 0) AS q3, greatest(max(q3 - q1), 1) AS w FROM quartiles GROUP BY ALL
), bounds AS (
    SELECT lang, source, signal, floor(q1 - {WIDTHS} * w) AS low, ceil(q3 + {WIDTHS} * w) AS high FROM spread
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars FROM signals d
WHERE NOT EXISTS (
    SELECT 1 FROM bounds b WHERE b.lang IS NOT DISTINCT FROM d.lang AND b.source IS NOT DISTINCT FROM d.source
      AND NOT CASE b.signal {" ".join(f"WHEN {i} THEN d.{s}" for i, s in enumerate(SIGNALS))} END BETWEEN b.low AND b.high)
"""
)
