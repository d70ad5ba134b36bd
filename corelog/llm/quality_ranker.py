"""Quality classifier by Bradley-Terry pairwise ranking (operator 7)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelog.llm.common import fresh, row_key, written
from corelog.llm.signals import BAG, SIGNALS, bag_of, split_words, with_signals

#: Labelled rows of either class that training draws at most, the least by a hash of the id.
MAX_LABELLED = 3000
#: Preference pairs (one better, one worse document) drawn from them.
MAX_PAIRS = 20000
#: Documents are rejected that score below this quantile of all labelled better documents' scores.
QUANTILE = 0.001
#: A bag's shares of words count by so much, and their weights are drawn to 0 by BAG_L2 (the signals' by a tenth of it).
BAG_SCALE = 30.0
BAG_L2 = 1e-2
#: Scores are whole numbers of 1 / SCALE, so that sums and thresholds don't depend on the order of work.
SCALE = 1000


@dataclass(frozen=True)
class Ranker:
    """Score = weighted sum of features; the log-odds that one document is preferred to another are their difference.

    Each signal x, as ln(1 + x), gives three features: itself, how far it is above `high`, how far below `low`. So a
    signal may count for much outside the range of good documents without counting inside it. The words themselves give
    BAG more: each bucket's count over words + 20.
    """

    low: tuple[float, ...]
    high: tuple[float, ...]
    weight: tuple[float, ...]
    bag: tuple[float, ...]

    def column(self, value: str) -> Column:
        """The score, rounded to whole 1 / SCALE, as bigint; NULL where there are no signals. value: of with_signals(weights)."""
        total = F.col(value)["bag"]
        for i, (lo, hi) in enumerate(zip(self.low, self.high, strict=True)):
            x = F.log1p(F.col(value)["signals"][i].cast("double"))
            w = self.weight[3 * i : 3 * i + 3]
            total = total + x * w[0] + F.greatest(x - hi, F.lit(0.0)) * w[1] + F.greatest(lo - x, F.lit(0.0)) * w[2]
        return F.round(total * SCALE).cast("bigint")

    def features(self, signals: np.ndarray) -> np.ndarray:
        x = np.log1p(signals.astype(float))
        return np.stack([x, np.maximum(x - self.high, 0), np.maximum(self.low - x, 0)], 2).reshape(len(x), -1)

    def scores(self, signals: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.features(signals) @ np.array(self.weight) + bags @ np.array(self.bag)


def fit_pairs(better: tuple[np.ndarray, np.ndarray], worse: tuple[np.ndarray, np.ndarray], *, pairs: int = MAX_PAIRS, steps: int = 100, seed: int = 7) -> Ranker:
    """Bradley-Terry weights: minimises mean log(1 + exp(-w (x_better - x_worse))) + sum of l2 w^2 / 2 by Newton steps.

    better, worse: (signals, bags), one row a document. Without rows in one of them there is nothing to prefer: weights are 0.
    """
    k = len(SIGNALS)
    if not len(better[0]) or not len(worse[0]):
        return Ranker((0.0,) * k, (0.0,) * k, (0.0,) * 3 * k, (0.0,) * BAG)
    low, high = np.quantile(np.log1p(better[0].astype(float)), [0.01, 0.99], axis=0)
    plain = Ranker(tuple(low.tolist()), tuple(high.tolist()), (0.0,) * 3 * k, (0.0,) * BAG)
    x, y = plain.features(better[0]), plain.features(worse[0])
    sd = np.maximum(np.concatenate([x, y]).std(0), 1e-3)
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(x), pairs), rng.integers(0, len(y), pairs)
    x, y = (np.concatenate([f / sd, bag * BAG_SCALE], 1) for f, bag in ((x, better[1]), (y, worse[1])))
    l2 = np.concatenate([np.full(3 * k, BAG_L2 / 10), np.full(BAG, BAG_L2)])
    w = np.zeros(x.shape[1])
    lead = lambda v: (x @ v)[i] - (y @ v)[j]
    loss = lambda v: np.mean(np.logaddexp(0, -lead(v))) + l2 @ v**2 / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(lead(w), -50, 50)))
        grad = (np.bincount(j, p, len(y)) @ y - np.bincount(i, p, len(x)) @ x) / pairs + l2 * w
        curve = np.diag(l2)
        for a in range(0, pairs, 2000):  # differences of a few pairs at a time
            q = p[a : a + 2000]
            root = (x[i[a : a + 2000]] - y[j[a : a + 2000]]) * np.sqrt(q * (1 - q) / pairs)[:, None]
            curve = curve + root.T @ root
        step = np.linalg.solve(curve, grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Ranker(plain.low, plain.high, tuple((w[: 3 * k] / sd).tolist()), tuple((w[3 * k :] * BAG_SCALE).tolist()))


def preferences(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labelled ids of df: rows with NULLs are left out, as are documents that have both labels."""
    said = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    return said.where("quality = other").select("doc_id", "quality").join(df.select("doc_id"), "doc_id", "left_semi")


def train(df: DataFrame, said: DataFrame, *, text: str = "text") -> Ranker:
    """The ranker, from a bounded sample of MAX_LABELLED documents of either class (see preferences); quality 1 is preferred to 0.

    Only the sample's texts are looked at: their ids, few by that bound, are broadcast to the scan.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    ids = said.where("quality = 1").orderBy(order, "doc_id").limit(MAX_LABELLED).unionByName(said.where("quality = 0").orderBy(order, "doc_id").limit(MAX_LABELLED))
    ids = written(ids, "drawn")
    rows = df.select("doc_id", F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    rows = written(rows.select("doc_id", "quality", "text", row_key().alias("key")).dropDuplicates(["key"]), "sample")
    scored, s = with_signals(rows, "text")
    docs = scored.select("key", "quality", F.col(s).alias("signals")).orderBy("doc_id", "key").toArrow()
    words = rows.select("key", F.explode(split_words(F.col("text"))).alias("word"))
    counts = words.groupBy("key", bag_of(F.col("word")).alias("bucket")).agg(F.count("*").cast("int").alias("n")).toArrow()
    keys = np.asarray(docs["key"])
    order = np.argsort(keys)
    bags = np.zeros((len(keys), BAG))
    if len(keys):
        bags[order[np.searchsorted(keys[order], np.asarray(counts["key"]))], np.asarray(counts["bucket"])] = np.asarray(counts["n"])
    bags /= bags.sum(1, keepdims=True) + 20
    signals = np.asarray(docs["signals"].combine_chunks().flatten(), dtype=np.int64).reshape(-1, len(SIGNALS))
    good = np.asarray(docs["quality"]) == 1
    return fit_pairs((signals[good], bags[good]), (signals[~good], bags[~good]))


def threshold(scored: DataFrame, said: DataFrame, quantile: float = QUANTILE) -> int | None:
    """The exact quantile of the scores of all labelled better documents; None without any. scored: (doc_id, score)."""
    # Whole-number scores: a histogram of their counts is small, merges exactly and gives the exact order statistic.
    known = scored.where("score IS NOT NULL").distinct().join(said.where("quality = 1"), "doc_id")
    below = known.groupBy("score").agg(F.count("*").alias("n")).orderBy("score").toPandas()
    if below.empty:
        return None
    at = int(np.searchsorted(np.cumsum(below["n"].to_numpy()), max(1, int(np.ceil(quantile * below["n"].sum())))))
    return int(below["score"].iloc[at])


def filter_ranked(df: DataFrame, labels: DataFrame, *, text: str = "text", score: str | None = "score", quantile: float = QUANTILE) -> DataFrame:
    """The rows of df that score at least the threshold: df's columns, and the score if it is given a name.

    One scan takes the sample that trains, a second one scores all rows and writes them with their scores to the shared
    folder; what stays is read from there, so signals are computed once. Only ids, labels and scores are shuffled.
    NULL text: score NULL, the row stays (nothing speaks against it); an empty text has signals
    0, 0, 0, 0, 5000 and no words. Ties at the threshold stay. Repeated rows are judged each. Without labels of both classes
    every row stays with score 0. Empty table: empty result. If df has a column of the score's name, ValueError is raised;
    other extra columns pass through.
    """
    if score and score.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column exists already: {score}")
    said = written(preferences(df, labels), "said")
    ranker = train(df, said, text=text)
    scored, s = with_signals(df, text, list(ranker.bag))
    (name,) = fresh(scored, "score")
    out = written(scored.withColumn(name, ranker.column(s)).drop(s), "scored")
    least = threshold(out.select("doc_id", F.col(name).alias("score")), said, quantile) if any(ranker.weight) else None
    if least is not None:
        out = out.where(F.col(name).isNull() | (F.col(name) >= least))
    return out.withColumnRenamed(name, score) if score else out.drop(name)
