import numpy as np
from pyspark.sql import functions as F

from corelog.llm import neighbours

ROWS = "vec_id long, embedding array<float>, label int, list string"


def recall(got, ids, x, k):
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    at = {v: i for i, v in enumerate(ids)}
    mine = {}
    for r in got:
        mine.setdefault(r["vec_id"], []).append(r)
    hits = 0
    for i, v in enumerate(ids):
        rows = sorted(mine[v], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, k + 1))
        assert all(abs(r["distance"] ** 2 - far[i, at[r["neighbour_id"]]]) < 1e-4 for r in rows)
        assert [r["distance"] for r in rows] == sorted(r["distance"] for r in rows)
        kth = np.partition(far[i], k - 1)[k - 1]
        hits += sum(far[i, at[r["neighbour_id"]]] <= kth + 1e-6 for r in rows)
    return hits / (len(ids) * k)


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 150)
    monkeypatch.setattr(neighbours, "GROUP_QUERIES", 300)
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(400, 20)), r.normal(size=(1, 20)) + 0.01 * r.normal(size=(300, 20)), r.normal(size=(8, 20)).repeat(15, 0)]).astype(np.float32)
    ids = [3 * i + 1 for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 0, "a") for i, v in zip(ids, x)], ROWS)
    got = neighbours.nearest_neighbours(df.repartition(3)).collect()
    assert recall(got, ids, x.astype(float), neighbours.K) >= 0.9


def test_copies_beyond_the_depth_go_to_the_least_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_calibrate", lambda *_: (3, 12))
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(200, 8)), np.ones((150, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "a") for i, v in enumerate(x)], ROWS)
    got = neighbours.nearest_neighbours(df, asking=F.col("id") >= 200).orderBy("vec_id", "rank").collect()
    assert len(got) == 150 * neighbours.K
    for r in got:
        want = [i for i in range(200, 350) if i != r["vec_id"]][r["rank"] - 1]
        assert (r["neighbour_id"], r["distance"]) == (want, 0.0)


def test_clustered_vectors_need_few_probes(spark):
    r = np.random.default_rng(7)
    x = (r.normal(size=(48, 16)).repeat(50, 0) + 0.05 * r.normal(size=(2400, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "a") for i, v in enumerate(x)], ROWS)
    rows, n, d = neighbours.vectors(df)
    index, coded = neighbours.build(rows, n, d)
    assert coded.count() == n == 2400 and index.probes <= len(index.centroids) / 4
    got = neighbours.nearest_neighbours(df, asking=F.col("id") % 20 == 0).collect()
    hits = []
    for q in range(0, 2400, 20):
        far = ((x.astype(float) - x[q]) ** 2).sum(1)
        far[q] = np.inf
        kth = np.sort(far)[neighbours.K - 1]
        hits += [far[g["neighbour_id"]] <= kth + 1e-6 for g in got if g["vec_id"] == q]
    assert len(hits) == 120 * neighbours.K and np.mean(hits) >= 0.9


def test_recall_of_the_registered_query(spark):
    from corelog.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in QUERIES["op3_neighbours"](spark, d).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = []
    for q in got:
        far = ((x - x[ids == q][0]) ** 2).sum(1)
        far[ids == q] = np.inf
        kth = np.sort(far)[neighbours.K - 1]
        hits.append(np.mean([far[ids == i][0] <= kth + 1e-9 for i in got[q]]))
    assert np.mean(hits) >= 0.9


def test_odd_rows(spark):
    good = [(i, [float(i), 1.0, 0.0], 0, None) for i in range(5)]
    odd = [(None, [1.0, 2.0, 3.0], 0, "x"), (90, None, 0, "x"), (91, [], 0, "x"), (92, [1.0], 0, "x"), (93, [1.0, float("nan"), 0.0], 0, "x"), (94, [1.0, None, 0.0], 0, "x"), good[2]]
    got = neighbours.nearest_neighbours(spark.createDataFrame(good + odd, ROWS), k=2).orderBy("vec_id", "rank").collect()
    assert [tuple(r)[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 1, 1), (2, 3, 2), (3, 2, 1), (3, 4, 2), (4, 3, 1), (4, 2, 2)]
    assert {r["distance"] for r in got} <= {1.0, 2.0}


def test_few_and_no_rows(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([], ROWS)).count() == 0
    assert neighbours.nearest_neighbours(spark.createDataFrame([(1, [1.0], 0, "x")], ROWS)).count() == 0
    two = neighbours.nearest_neighbours(spark.createDataFrame([(1, [1.0], 0, "x"), (2, [1.0], 0, "x")], ROWS)).collect()
    assert sorted(tuple(r) for r in two) == [(1, 2, 1, 0.0), (2, 1, 1, 0.0)]


def test_tables_give_the_distance_to_the_coded_vector():
    r = np.random.default_rng(3)
    index = neighbours.Index(r.normal(size=(4, 20)).astype("f4"), r.normal(size=(neighbours.PARTS, neighbours.WORDS, 2)).astype("f4"), 4, 1, None, None)
    q, lists = r.normal(size=(3, 20)).astype("f4"), np.array([0, 3, 1, 1])
    codes = r.integers(0, 256, (4, neighbours.PARTS)).astype(np.uint8)
    y = index.centroids[lists] + index.words[np.arange(neighbours.PARTS), codes].reshape(4, -1)[:, :20]
    assert np.allclose(neighbours._asymmetric(index, q, codes, lists), ((q[:, None] - y[None]) ** 2).sum(2), atol=1e-3)
