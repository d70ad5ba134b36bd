"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelog.llm.common import small, written
from corelog.plans.ship import ship

#: Neighbours of each vector.
K = 10
#: Parts of a residual, and codewords of each part (a code is one byte).
PARTS = 16
WORDS = 256
#: Rounds of k-means, for the centroids and for the codewords, over a sample of so many vectors for each list (the least by
#: a hash of the id), WORDS * TRAIN_EACH at least. With about sqrt(n) lists the fit's work grows as n.
ROUNDS = 6
TRAIN_EACH = 64
#: Rows of a partition of the sample.
TRAIN_ROWS = 50_000
#: Queries by which the number of lists to probe and of candidates to rerank are set, and the share of true neighbours
#: that each of the two must reach on them.
PROBE_QUERIES = 256
TARGET = 0.975
#: Vectors of a block of lists, and queries that meet it in one group.
BLOCK_ROWS = 8192
GROUP_QUERIES = 16384
#: Asymmetric distances that differ by less than this share tie; candidates that are reranked at a time.
TIE = 1e-5
RERANK_ROWS = 1 << 17
#: Sums are whole numbers of 1 / FIXED, so centroids don't depend on the order of work.
FIXED = float(1 << 24)


@dataclass(frozen=True)
class Index:
    """centroids (lists, d); words (PARTS, WORDS, d / PARTS); probes; depth; first block and number of blocks of each list."""

    centroids: np.ndarray
    words: np.ndarray
    probes: int
    depth: int
    block: np.ndarray
    split: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less |x|^2."""
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = _parts(x - self.centroids[lists], self.words.shape[2])
        out = np.empty((len(x), PARTS), np.uint8)
        for j in range(PARTS):
            w = self.words[j]
            out[:, j] = ((w**2).sum(1) - 2 * r[:, j] @ w.T).argmin(1)
        return out


def _parts(x: np.ndarray, width: int) -> np.ndarray:
    """(n, PARTS, width), with zeros where the dimension isn't a multiple."""
    out = np.zeros((len(x), PARTS * width), x.dtype)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), PARTS, width)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, d)


def vectors(df: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int, int]:
    """(id, v) of the usable rows, their number and dimension.

    Usable: id and embedding are not NULL, all components are finite numbers, and the dimension is the most frequent one
    (ties: the least). Of rows with equal ids the one with the least embedding counts.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    one = written(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    sizes = sorted((-r["n"], r["d"]) for r in one.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return one, 0, 0
    n, d = -sizes[0][0], sizes[0][1]
    return one.where(F.size("v") == d), n, d


def _lloyd(rows: DataFrame, d: int, start: np.ndarray, rounds: int, place) -> np.ndarray:
    """Rounds of k-means over rows. start: (cells, width); place(x, cells) -> (points, cell of each point)."""
    cells = start.copy()
    width = cells.shape[1]
    spark = rows.sparkSession
    names, kinds = ["cell", "n", "total"], "cell long, n long, total array<long>"

    def batch(hit: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> pa.Table:
        total = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * width, pa.int32()), pa.array(sums.reshape(-1)))
        return pa.Table.from_arrays([pa.array(hit), pa.array(counts), total], names)

    def reduce(table: pa.Table) -> pa.Table:
        hit, where = np.unique(np.asarray(table["cell"]), return_inverse=True)
        sums, counts = np.zeros((len(hit), width), np.int64), np.zeros(len(hit), np.int64)
        np.add.at(sums, where, np.asarray(table["total"].combine_chunks().flatten()).reshape(-1, width))
        np.add.at(counts, where, np.asarray(table["n"]))
        return batch(hit, counts, sums)

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(cells)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            sums, counts = np.zeros((len(now), width), np.int64), np.zeros(len(now), np.int64)
            for rows in batches:
                if rows.num_rows:
                    points, cell = place(_matrix(rows.column(0), d), now)
                    order = np.argsort(cell, kind="stable")
                    head = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    which = cell[order][head]
                    sums[which] += np.add.reduceat(np.round(points[order].astype(np.float64) * FIXED).astype(np.int64), head)
                    counts += np.bincount(cell, minlength=len(now))
            hit = np.flatnonzero(counts)
            yield from batch(hit, counts[hit], sums[hit]).to_batches()

        # Sums travel as vectors, and are added up by ranges of cells.
        sent = rows.select("v").mapInArrow(partial, kinds)
        found = sent.groupBy((F.col("cell") % 64).alias("range")).applyInArrow(reduce, kinds).toArrow()
        total = np.asarray(found["total"].combine_chunks().flatten()).reshape(-1, width) if found.num_rows else np.zeros((0, width))
        cells[np.asarray(found["cell"], dtype=np.int64)] = (total / FIXED / np.asarray(found["n"], dtype=float)[:, None]).astype(np.float32)
    return cells


def build(rows: DataFrame, n: int, d: int, k: int = K) -> tuple[Index, DataFrame]:
    """The index of (id, v) rows, and the table (id, v, list, codes, block).

    There are about sqrt(n) lists. Centroids and codewords are k-means over a sample of TRAIN_EACH vectors a list, started
    from those least by a hash of the id; every vector is indexed. How many lists are probed and how deep is reranked is measured, not set: on PROBE_QUERIES vectors, whose
    true neighbours are found among all, by how much it takes to reach TARGET.
    """
    spark = rows.sparkSession
    lists = max(1, int(np.ceil(np.sqrt(n))))
    wanted = TRAIN_EACH * max(lists, WORDS)
    hashed = rows.select("id", "v", F.xxhash64("id", F.lit(1)).alias("h"))
    if wanted < n:
        hashed = hashed.where(F.col("h") / F.lit(2.0**64) + 0.5 <= wanted / n)
    sample = written(hashed.repartition(-(-min(wanted, n) // TRAIN_ROWS), "id"), "sample")
    begin = sample.orderBy("h", "id").limit(max(lists, min(n, 4 * WORDS))).select("v").toArrow()
    start = _matrix(begin["v"].combine_chunks(), d).copy()
    lists = min(lists, len(start))
    centroids = _lloyd(sample, d, start[:lists], ROUNDS, lambda x, c: (x, ((c**2).sum(1) - 2 * x @ c.T).argmin(1)))
    width = -(-d // PARTS)
    plain = Index(centroids, np.zeros((PARTS, WORDS, width), np.float32), lists, 0, np.zeros(0), np.zeros(0))
    residual = _parts(start - centroids[plain.assign(start)], width)
    some = residual[np.arange(WORDS) % len(residual)]
    # Starting words that are equal are moved apart a little: else all but one of them would stay empty.
    words = some.transpose(1, 0, 2) + np.random.default_rng(5).normal(0, 1e-4, (PARTS, WORDS, width)).astype(np.float32)
    shared = spark.sparkContext.broadcast(centroids)

    def place(x: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = Index(shared.value, flat.reshape(PARTS, WORDS, width), 0, 0, None, None)
        own = at.assign(x)
        code = at.codes(x, own).astype(np.int64)
        return _parts(x - at.centroids[own], width).reshape(-1, width), (code + np.arange(PARTS) * WORDS).reshape(-1)

    words = _lloyd(sample, d, words.reshape(-1, width), ROUNDS, place).reshape(PARTS, WORDS, width)
    index = Index(centroids, words, lists, 0, np.zeros(0), np.zeros(0))
    model = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            own = model.value.assign(x)
            codes = pa.array([c.tobytes() for c in model.value.codes(x, own)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), codes], ["id", "v", "list", "codes"])

    coded = written(rows.select("id", "v").mapInArrow(encode, "id long, v array<float>, list int, codes binary"), "coded")
    probes, depth = _calibrate(coded, index, d, k)
    counted = dict(coded.groupBy("list").count().collect())
    sizes = np.array([counted.get(i, 0) for i in range(lists)])
    block, split = _blocks(centroids, sizes)
    return Index(centroids, words, probes, depth, block, split), coded


def _blocks(centroids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of each list and how many it has. Near lists share blocks, so a query meets few of them."""
    left, order, at = set(range(len(sizes))), [], 0
    while left:
        # A walk from list to nearest list not yet taken, among lists as many as fill a block at a time.
        rest = np.array(sorted(left))
        near = rest[np.argsort(((centroids[rest] - centroids[rest[0]]) ** 2).sum(1), kind="stable")]
        total = np.cumsum(sizes[near])
        take = near[: max(1, int(np.searchsorted(total, BLOCK_ROWS, side="right")))]
        order.append(take)
        left -= set(take.tolist())
    block, split = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    for take in order:
        block[take] = at
        split[take] = max(1, -(-int(sizes[take].sum()) // BLOCK_ROWS)) if len(take) == 1 else 1
        at += int(split[take].max())
    return block, split


def _calibrate(coded: DataFrame, index: Index, d: int, k: int) -> tuple[int, int]:
    """(lists to probe, candidates to rerank), by the sample queries' true neighbours among all vectors."""
    spark = coded.sparkSession
    sample = coded.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(PROBE_QUERIES).select("id", "v").collect()
    qid, q = np.array([r["id"] for r in sample], np.int64), np.array([r["v"] for r in sample], np.float32)
    asked = spark.sparkContext.broadcast((qid, q, index))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, _ = asked.value
        for batch in batches:
            y = _matrix(batch.column(1), d)
            far = (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T
            far[ids[:, None] == np.asarray(batch.column(0))] = np.inf
            m = min(k, far.shape[1])
            if m:
                top = np.argpartition(far, m - 1, 1)[:, :m]
                rows = np.repeat(np.arange(len(ids)), m)
                at = pa.array(top.reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(far[rows, top.reshape(-1)].astype(np.float64)), batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at)], ["q", "far", "id", "list", "codes"])

    near = coded.select("id", "v", "list", "codes").mapInArrow(nearest, "q long, far double, id long, list int, codes binary").toPandas()
    near = near[np.isfinite(near["far"])].sort_values(["q", "far", "id"]).groupby("q").head(k)
    if near.empty:
        return index.probes, k
    rank = np.argsort(np.argsort(index.distances(q), 1, kind="stable"), 1, kind="stable")
    probes = int(np.quantile(rank[near["q"], near["list"]], TARGET, method="higher")) + 1
    own = np.frombuffer(b"".join(near["codes"]), np.uint8).reshape(-1, PARTS)
    mark = np.concatenate([_asymmetric(index, q[i : i + 1], c[None], np.array([n]))[0] for i, c, n in zip(near["q"], own, near["list"], strict=True)])
    marks = spark.sparkContext.broadcast([np.sort(m.to_numpy()) for _, m in pd.Series(mark, near["q"].to_numpy()).groupby(level=0)])
    names = sorted(near["q"].unique())

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x, at = asked.value
        counts = [np.zeros(len(m), np.int64) for m in marks.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
            far = _asymmetric(at, x, codes, np.asarray(batch.column(0)))
            for i, (m, name) in enumerate(zip(marks.value, names, strict=True)):
                counts[i] += np.searchsorted(np.sort(far[name]), m)
        flat = np.concatenate(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "n"])

    ranks = coded.select("list", "codes").mapInArrow(before, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()["n"]
    return probes, int(np.quantile(ranks, TARGET, method="higher")) + 2


def _asymmetric(index: Index, q: np.ndarray, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """(queries, vectors): squared distances of exact queries to coded vectors, by tables of the codewords' products.

    |q - c - p|^2 = |q|^2 - 2 q.c - 2 q.p + |c + p|^2: the last term is the vector's, and q.p is a sum of PARTS entries of
    the query's table (PARTS, WORDS).
    """
    d = index.centroids.shape[1]
    p = index.words[np.arange(PARTS), codes].reshape(len(codes), -1)[:, :d]
    whole = ((index.centroids[lists] + p) ** 2).sum(1)
    table = np.einsum("qjw,jcw->qjc", _parts(q, index.words.shape[2]), index.words)
    dot = np.zeros((len(q), len(codes)), np.float32)
    for j in range(PARTS):
        dot += table[:, j].take(codes[:, j], 1)
    return (q**2).sum(1)[:, None] - 2 * (q @ index.centroids.T)[:, lists] - 2 * dot + whole


def _search(shared, d: int, k: int, batch: int = 256):
    """One block against one group of queries: for each query, the k exactly nearest of its `depth` best candidates here."""

    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        index: Index = shared.value
        ids = np.asarray(members["id"])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        lists = np.asarray(members["list"])[order]
        y = _matrix(members["v"].combine_chunks(), d)[order]
        codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(-1, PARTS)[order]
        here = np.unique(lists)
        qids, q = np.asarray(asked["id"]), _matrix(asked["v"].combine_chunks(), d)
        out: list[list[np.ndarray]] = [[], [], []]
        for a in range(0, len(q), batch):
            x, me = q[a : a + batch], qids[a : a + batch]
            all_far = index.distances(x)
            limit = np.partition(all_far, index.probes - 1, 1)[:, index.probes - 1 : index.probes]
            probed = all_far[:, here] <= limit
            far = np.full((len(x), len(ids)), np.inf, np.float32)
            for i, name in enumerate(here):
                rows = np.flatnonzero(probed[:, i])
                cols = np.flatnonzero(lists == name)
                if len(rows):
                    far[np.ix_(rows, cols)] = _asymmetric(index, x[rows], codes[cols], lists[cols])
            far[me[:, None] == ids] = np.inf
            m = min(index.depth, far.shape[1])
            kth = np.partition(far, m - 1, 1)[:, m - 1]
            # All that tie with the last candidate are reranked with it.
            near = np.isfinite(far) & (far <= (kth + TIE * (1 + np.abs(kth)))[:, None])
            row, col = np.nonzero(near)
            exact = np.empty(len(row))
            for i in range(0, len(row), RERANK_ROWS):
                r, c = row[i : i + RERANK_ROWS], col[i : i + RERANK_ROWS]
                exact[i : i + RERANK_ROWS] = ((x[r].astype(np.float64) - y[c]) ** 2).sum(1)
            order = np.lexsort((col, exact, row))  # columns ascend with ids, so that ties go to the least
            row, col, exact = row[order], col[order], exact[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            ok = nth < k
            out[0].append(me[row[ok]])
            out[1].append(ids[col[ok]])
            out[2].append(exact[ok])
        parts = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"id": parts[0], "other": parts[1], "far": parts[2]})

    return run


def nearest_neighbours(df: DataFrame, *, k: int = K, key: str = "vec_id", embedding: str = "embedding", asking: Column | None = None) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest others of each vector that asks, by Euclidean distance.

    asking: a condition on the column `id`; without one every vector is a query. All vectors are searched in any case.

    Approximate, with a share of the true neighbours that is calibrated (see build): at least TARGET of them stand in
    probed lists, and at least TARGET of those among the reranked candidates. Distances are exact; ties go to the lesser id.

    A block of lists meets the queries that probe one of its lists, once each, in groups of a bounded number; per block
    only k rows a query go on.

    NULL ids, NULL or empty embeddings, NULL, NaN or infinite components and dimensions other than the most frequent one:
    such rows are neither queries nor neighbours. Rows with equal ids count once. Vectors that have fewer than k others get
    all of them; equal vectors are neighbours at distance 0. Empty table: empty result. Extra columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    result = "vec_id long, neighbour_id long, rank int, distance double"
    rows, n, d = vectors(df, key, embedding)
    if n < 2:
        return spark.createDataFrame([], result)
    index, coded = build(rows, n, d, k)
    shared = spark.sparkContext.broadcast(index)
    where = spark.createDataFrame([(int(i), int(b), int(s)) for i, (b, s) in enumerate(zip(index.block, index.split, strict=True))], "list int, first long, split long")
    placed = coded.join(where, "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id", F.lit(3)), "split"))
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Index = shared.value
        last = at.block + at.split
        for batch in batches:
            far = at.distances(_matrix(batch.column(1), d))
            probed = far <= np.partition(far, at.probes - 1, 1)[:, at.probes - 1 : at.probes]
            hit = np.zeros((len(far), int(last.max())), bool)
            for i in range(far.shape[1]):
                hit[:, at.block[i] : last[i]] |= probed[:, i : i + 1]
            row, block = np.nonzero(hit)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(far) + 1)), pa.int32()), pa.array(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "v", "blocks"])

    queries = coded if asking is None else coded.where(asking)
    probing = written(queries.select("id", "v").mapInArrow(ask, "id long, v array<float>, blocks array<long>"), "probing")
    asked = probing.select("id", "v", F.explode("blocks").alias("block"))
    # A block is copied once for each group of its own queries: what travels grows with the probes, not with n^2.
    parts = small(written(asked.groupBy("block").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts")), "parts"))
    members = placed.join(parts, "block").select("id", "v", "list", "codes", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), "parts").cast("int"))
    met = members.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_search(shared, d, k), "id long, other long, far double")
    best = met.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k).alias("best"))
    out = best.select(F.col("id").alias("vec_id"), F.posexplode("best").alias("i", "b"))
    return out.select("vec_id", F.col("b.other").alias("neighbour_id"), (F.col("i") + 1).alias("rank"), F.sqrt("b.far").alias("distance"))
