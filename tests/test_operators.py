"""Operators against plain Python, their invariants and their refusals."""

import math
import random
import re
import unicodedata
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corelog.functions import gates, mesh, soil
from corelog.functions import text as T
from corelog.operators import aggregates, conformal, folds, grids, inference, joins, profiles, quantiles, sampling, spatial
from corelog.operators.aggregates import mean_pairwise_distance
from corelog.sources import tables


def test_asof_is_half_open_and_keeps_rows(spark):
    left = spark.createDataFrame([("a", 1.15), ("a", 3.0), ("a", 0.0), ("b", 0.5), (None, 0.5)], "g string, z double")
    right = spark.createDataFrame([("a", 0.0, 1.0, "topsoil"), ("a", 1.0, 2.85, "gravelly silt"), ("b", 0.6, 2.0, "clay"), (None, 0.0, 1.0, "no key")], "g string, top double, bottom double, text string")
    got = {(r.g, r.z): r.text for r in joins.asof_interval(left, right, ["g"], "z", "top", "bottom", ["text"]).collect()}
    assert got == {("a", 1.15): "gravelly silt", ("a", 3.0): None, ("a", 0.0): "topsoil", ("b", 0.5): None, (None, 0.5): None}


def test_asof_empty_sides(spark):
    left = spark.createDataFrame([("a", 1.0)], "g string, z double")
    none = spark.createDataFrame([], "g string, top double, bottom double, text string")
    assert joins.asof_interval(left, none, ["g"], "z", "top", "bottom", ["text"]).first().text is None
    assert joins.asof_interval(left.limit(0), none, ["g"], "z", "top", "bottom", ["text"]).count() == 0


def test_many_to_one_refuses_repeated_keys(spark):
    one = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(ValueError, match="not unique"):
        joins.many_to_one(one.select("k"), one, ["k"])


def test_multiset_alignment_is_one_to_one(spark):
    left = spark.createDataFrame([(1, i) for i in range(3)] + [(2, 9)], "k long, i long")
    right = spark.createDataFrame([(1, f"r{i}") for i in range(3)], "k long, name string")
    got = joins.multiset_align(left, right, ["k"], ["name"], ["i"], ["name"]).collect()
    assert sorted(r.name for r in got if r.k == 1) == ["r0", "r1", "r2"] and [r.name for r in got if r.k == 2] == [None]
    assert joins.multiset_equal(left, left) and not joins.multiset_equal(left, left.limit(3))


@pytest.mark.parametrize("seed", range(3))
def test_block_permutation_is_a_bijection_in_strata(spark, seed):
    r = random.Random(seed)
    rows, n = [], 0
    for g in range(40):
        for d in range(r.randrange(1, 9)):
            rows.append((n, f"g{g}", float(d), f"s{g % 3}"))
            n += 1
    df = spark.createDataFrame(rows, "row long, g string, depth double, s string")
    moved = sampling.block_permutation(df, "row", "g", "depth", "s", seed)
    got = {x.row: (x.donor, x._block) for x in moved.collect()}
    assert sorted(got) == sorted(d for d, _ in got.values()) == list(range(n))
    by = {x[0]: x for x in rows}
    assert all(by[a][3] == by[b][3] and by[a][2] == by[b][2] for a, (b, _) in got.items())
    assert all(by[a][1] != by[b][1] for a, (b, block) in got.items() if block)
    donors = [x.donor for x in sampling.clipped_permutation(df, "row", "g", "depth", seed).collect()]
    assert len(set(donors)) < n  # the older rule repeats donors


def test_permuted_moves_every_value_but_single_ones(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b", i) for i in range(10)], "k long, s string, v long")
    got = {r.k: r.v for r in sampling.permuted(df, "k", ["s"], ["v"], 1).collect()}
    assert sorted(got.values()) == list(range(10)) and got[9] == 9 and all(got[k] != k for k in range(9))


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.8, 0.999])
def test_order_statistic_is_exact(spark, alpha):
    r = random.Random(5)
    x = [r.choice([r.gauss(0, 1), 1.0]) for _ in range(500)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(x)] + [(None, 0), (float("nan"), 1)], "s double, g int")
    k = max(1, min(500, math.ceil(501 * alpha)))
    assert conformal.order_statistic(df, [], "s", alpha).first().q == sorted(x)[k - 1]
    for row in conformal.order_statistic(df, ["g"], "s", alpha).collect():
        part = sorted(v for i, v in enumerate(x) if i % 3 == row.g)
        assert row.q == part[max(1, min(len(part), math.ceil((len(part) + 1) * alpha))) - 1]


def test_percentiles_of_many_ranges(spark):
    r = random.Random(8)
    x = [(g, r.choice([r.lognormvariate(0, 3), 2.0])) for g in ("a", None) for _ in range(1500)] + [("small", 1.0), ("small", 2.0), ("small", float("nan")), ("small", None)]
    df = spark.createDataFrame(x, "g string, v double")
    got = {row.g: row for row in quantiles.percentiles(df, ["g"], "v", {"lo": 0.0, "q": 0.3, "m": 0.5, "hi": 1.0}).collect()}
    for g in ("a", None, "small"):
        part = [v for h, v in x if h == g and v is not None and v == v]
        assert got[g].n == len(part) and [got[g].lo, got[g].q, got[g].m, got[g].hi] == pytest.approx(np.quantile(part, [0, 0.3, 0.5, 1]).tolist())
    assert quantiles.percentiles(df.limit(0), [], "v", {"q": 0.5}).count() == 0
    weighted = quantiles.percentiles(spark.createDataFrame([(1.0, 3), (5.0, 1)], "v double, c long"), [], "v", {"q": 0.75}, count="c").first()
    assert (weighted.n, weighted.q) == (4, pytest.approx(2.0))


def test_constant_columns_empty_sides_and_zero_weights(spark):
    df = spark.createDataFrame([(True, 1.0, 0.0, "a"), (True, 1.0, 0.0, "b"), (False, 1.0, 0.0, "a")], "f boolean, x double, w double, c string")
    assert aggregates.smd(df, "f", ["x"]).first()[0] is None
    assert aggregates.total_variation(df.where("f"), "f", "c").first().tv is None
    assert df.agg(aggregates.effective_fraction("w").alias("e")).first().e is None
    assert [tuple(r) for r in aggregates.binned_calibration(df, "x", "w").collect()] == [(0, 3, 1.0, 0.0)]
    assert aggregates.group_calibration(df, "c", "x", "w", "w", least=1).where("c = 'a'").first().scale == 1.0
    assert [r.z for r in aggregates.masked_standardise(df, "x", "f", "z").orderBy("f").collect()] == [None, 0.0, 0.0]
    assert df.select(inference.effect(F.col("x"), F.col("w")).alias("e")).first().e is None
    assert aggregates.z_scored_rmse(df, "x", "w").first().z_rmse is None


def test_equal_points_stay_apart(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0)], "k string, at double")
    i = spark.createDataFrame([("a", 0.0, 2.0, 7), ("a", 0.5, 3.0, 3)], "k string, top double, bottom double, n int")
    assert [tuple(r) for r in joins.first_containing(p, i, ["k"], "at", "top", "bottom", "n", ["n"]).collect()] == [("a", 1.0, 3)] * 2
    grid = spark.createDataFrame([(a, b, float(10 * a + b)) for a in range(3) for b in range(3)], "i int, j int, value double")
    at = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5), (1.5, 2.0), (3.0, 0.0)], "x double, y double")
    axes = {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0, "nx": 3, "ny": 3}
    assert sorted(r.sample for r in joins.raster_bilinear(at, grid, "x", "y", fill=-1.0, **axes).collect()) == [-1.0, 5.5, 5.5, 17.0]


def test_multiset_align_stops_on_a_row_without_partner(spark):
    a, b = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), spark.createDataFrame([(1, 5)], "k int, w int")
    assert joins.multiset_align(a, b, ["k"], ["w"], ["v"], ["w"]).count() == 2
    with pytest.raises(Exception, match="no partner"):
        joins.multiset_align(a, b, ["k"], ["w"], ["v"], ["w"], strict=True).collect()


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_asof_ranges_agree(spark, ranges):
    r = random.Random(ranges)
    layers = [(r.choice("ab"), float(t), t + r.choice([0.5, 3.0, 40.0]), n) for n, t in enumerate(r.sample(range(100), 30))]
    points = [(r.choice(["a", "b", "c", None]), r.uniform(-5, 110)) for _ in range(300)]
    got = joins.asof_interval(spark.createDataFrame(points, "k string, at double"), spark.createDataFrame(layers, "k string, top double, bottom double, n int"), ["k"], "at", "top", "bottom", ["n"], ranges=ranges)
    want = []
    for k, at in points:
        below = [x for x in layers if x[0] == k and x[1] <= at]
        best = max(below, key=lambda x: x[1]) if below else None
        want.append((k, at, best[3] if best and at < best[2] else None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_neighbours_of_all_points_at_any_distance(spark):
    r = random.Random(12)
    rows = [(i, r.gauss(0, 100), r.gauss(0, 1), r.choice("aab")) for i in range(80)] + [(99, 5000.0, 0.0, "c")]
    p = spark.createDataFrame(rows, "id long, x double, y double, g string")
    got = {}
    for x in spatial.knn(p, p, "id", ["g"], 70, 3.0, other="g").collect():
        got.setdefault(x.id, []).append((x["_id"], x["_d"]))
    for i, x, y, g in rows:
        far = sorted((math.hypot(x - a, y - b), j) for j, a, b, h in rows if h != g)[:70]
        assert [j for _, j in far] == [j for j, _ in sorted(got[i], key=lambda v: (v[1], v[0]))]


def test_bad_profiles_are_skipped_or_stop(spark):
    rows = [("a", 1.0, 5.0, 0.5), ("a", 2.0, 5.0, 0.5), ("b", 1.0, 5.0, 0.5), ("b", 1.0, 5.0, 0.5), ("c", 1.0, float("nan"), 0.5), ("c", 2.0, 3.0, 0.5)]
    df = spark.createDataFrame(rows, "loc string, z double, n double, w double")
    assert [r.loc for r in profiles.liquefaction_potential(df, ["loc"], "z", "n", "w", 0.2, skip_bad=True).collect()] == ["a"]
    with pytest.raises(Exception, match="repeated depth"):
        profiles.liquefaction_potential(df, ["loc"], "z", "n", "w", 0.2).collect()


def test_terms_are_cut_from_compounds_but_not_from_words():
    cut = T.delete_terms
    assert cut("東京駅前地区の砂", {"駅前"}) == "東京 地区の砂"
    assert cut("マトリックスの砂", {"ック"}) == "マトリックスの砂" and cut("からなる砂", {"から"}) == "からなる砂"
    assert cut("No3 site", {"No"}) == "No3 site" and cut("No3 site", {"No3"}) == "site"
    assert cut("駅前砂岩", {"砂岩", "駅前"}, protected=["砂岩"]) == "砂岩"


def test_shifted_quantile_against_a_loop(spark):
    r = random.Random(2)
    cal = [(r.choice("ab"), r.gauss(0, 1), r.choice([1.0, 2.0])) for _ in range(60)]
    test = [(i, r.choice("abc"), r.choice([0.5, 5.0, 500.0])) for i in range(40)]
    got = {x.k: x.q for x in conformal.shifted_quantile(spark.createDataFrame(test, "k long, g string, w double"), spark.createDataFrame(cal, "g string, s double, c double"), "k", ["g"], "s", "c", "w", 0.8).collect()}
    for k, g, w in test:
        mine = sorted((s, c) for h, s, c in cal if h == g)
        total, run, want = sum(c for _, c in mine) + w, 0.0, math.inf if mine else None
        for s, c in mine:
            run += c
            if run >= 0.8 * total - 1e-9:
                want = s
                break
        assert got[k] == want


def test_isotonic_inverse():
    grid = np.linspace(0, 1, 11)
    level = np.minimum(1, grid**2)
    assert conformal.inverse_levels(grid, level, np.array([0.0, 0.25, 1.0])) == pytest.approx([0, 0.5, 1])


def test_hashed_rank_is_the_order_of_hashes(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    got = sampling.hashed_rank(df, "k", 3).orderBy("_r").collect()
    import hashlib

    want = sorted(range(500), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    assert [r.k for r in got] == want and {r["_n"] for r in got} == {500} and [r["_r"] for r in got] == list(range(1, 501))


def test_order_statistic_of_nothing(spark):
    assert conformal.order_statistic(spark.createDataFrame([], "s double"), [], "s", 0.5).count() == 0


def test_weighted_quantile_with_infinite_atom(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 5.0, 0.0)], "g string, v double, w double")
    q = {r.g: r.q for r in conformal.weighted_quantile(df, ["g"], "v", "w", 0.9, atom=5.0).collect()}
    assert q["a"] == math.inf
    q = {r.g: r.q for r in conformal.weighted_quantile(df, ["g"], "v", "w", 0.5).collect()}
    assert q == {"a": 1.0, "b": 5.0}


@pytest.mark.parametrize("block", [7, 4096])
def test_local_quantiles_against_a_loop(spark, block):
    r = random.Random(3)
    cal = [(r.random(), r.random()) for _ in range(60)]
    test = [(i, r.random()) for i in range(20)] + [(99, 1e9)]
    got = conformal.local_quantiles(spark.createDataFrame(test, "id long, x double"), spark.createDataFrame(cal, "score double, x double"), "id", ["x"], "score", 0.8, 0.1, block=block).collect()
    assert len(got) == len(test)
    for row in got:
        x = dict(test)[row.id]
        s = sorted(cal)
        w = np.exp(-((np.array([c[1] for c in s]) - x) ** 2) / 0.02)
        want = s[-1][0] if w.sum() <= 0 else s[min(int(np.searchsorted(np.cumsum(w) / w.sum(), 0.8)), 59)][0]
        assert row.q == pytest.approx(want)


def test_pooling_and_isotonic_levels(spark):
    assert conformal.pool(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    rng = np.random.default_rng(1)
    z = spark.createDataFrame([(float(v),) for v in 2 * rng.standard_normal(4000)], "z double")
    grid, level = conformal.isotonic(z, "z")
    assert (np.diff(level) >= 0).all() and level[int(0.1 * 2000)] > 0.2  # wider than normal: more mass in the tails


@pytest.mark.parametrize("seed", range(3))
def test_knn_against_brute_force(spark, seed):
    r = random.Random(seed)
    pts = [(i, r.gauss(0, 1) ** 3, r.random(), i % 4) for i in range(120)] + [(500 + i, 0.0, 0.0, 9) for i in range(3)]
    df = spark.createDataFrame(pts, "id long, x double, y double, code int")
    got = {}
    for row in spatial.knn(df, df, "id", [], 3, 0.05, other="code").collect():
        got.setdefault(row.id, []).append((row["rank"], row._id))
    for i, x, y, c in pts:
        want = sorted((math.hypot(x - u, y - v), j) for j, u, v, k in pts if k != c)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_knn_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert spatial.knn(df, df.limit(0), "id", [], 2, 1.0).count() == 0
    assert spatial.knn(df.limit(0), df, "id", [], 2, 1.0).count() == 0


def test_mean_pairwise_distance_by_loop(spark):
    r = random.Random(2)
    v = [[r.random() for _ in range(4)] for _ in range(25)]
    df = spark.createDataFrame([*enumerate(v), (99, None)], "id long, v array<double>")
    want = np.mean([np.linalg.norm(np.array(a) - b) for i, a in enumerate(v) for b in v[i + 1 :]])
    assert mean_pairwise_distance(df, "id", "v", blocks=4).first()[0] == pytest.approx(want)


def test_mesh_codes_and_neighbours(spark):
    df = spark.createDataFrame([(35.68, 139.76)], "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    row = df.select(mesh.mesh_code(lat, lon, 1).alias("a"), mesh.mesh_code(lat, lon, 2).alias("b"), mesh.mesh_neighbours(F.lit("533900")).alias("n"), mesh.mesh_neighbours(F.lit("000000")).alias("corner")).first()
    assert row.a == "5339" and row.b == "533946"
    assert len(set(row.n)) == 8 and "523870"[:4] == "5238" and "523877" in row.n and len(row.corner) == 3
    with pytest.raises(Exception, match="outside the mesh"):
        df.select(mesh.mesh_code(lat, F.lit(10.0)).alias("x")).collect()


def test_profiles_on_known_values(spark):
    p = spark.createDataFrame([("a", 10.0, 10.0), ("a", 20.0, 20.0), ("b", 5.0, 50.0)], "loc string, depth double, n double")
    v = profiles.vs30(p, ["loc"], "depth", "n").collect()
    v10, v20 = 97 * 10**0.314, 97 * 20**0.314
    assert [r.loc for r in v] == ["a"] and v[0].vs30 == pytest.approx(30 / (10 / v10 + 10 / v20 + 10 / v20))
    b = {r.loc: r.stratum for r in profiles.bearing(p, ["loc"], "depth", "n").collect()}
    assert b == {"a": math.inf, "b": 5.0}
    assert {r.loc: r.area for r in profiles.trapezoid(p, ["loc"], "depth", F.col("n"), "area").collect()} == {"a": 150.0, "b": 0.0}
    with pytest.raises(ValueError, match="positive"):
        profiles.liquefaction_potential(p, ["loc"], "depth", "n", "n", 0.0)
    twice = p.unionByName(p).withColumn("w", F.lit(0.0))
    with pytest.raises(Exception, match="repeated depth"):
        profiles.liquefaction_potential(twice, ["loc"], "depth", "n", "w", 0.2).collect()
    assert {r.loc: r.ok for r in profiles.ascending(twice, ["loc"], "depth").collect()} == {"a": False, "b": False}


def test_soil_without_water_is_dry(spark):
    df = spark.createDataFrame([(2.0, None), (2.0, float("nan")), (2.0, 1.0)], "z double, w double")
    got = [tuple(r) for r in df.select(*soil.stresses(F.col("z"), F.col("w"))).collect()]
    assert got[0] == got[1] == (34.0, 34.0) and got[2] == pytest.approx((36.0, 26.19))


def test_smoothing_against_numpy(spark):
    r = random.Random(4)
    a = np.array([[r.choice([None, r.random(), r.random()]) for _ in range(9)] for _ in range(7)], object)
    df = spark.createDataFrame([(i, j, a[i, j]) for i in range(7) for j in range(9)], "i int, j int, value double")
    got = {(x.i, x.j): x.value for x in grids.gaussian(df, 0.8).collect()}
    k = np.array([math.exp(-0.5 * (o / 0.8) ** 2) for o in range(-3, 4)])
    k /= k.sum()
    s = np.array([[x or 0.0 for x in row] for row in a])
    w = np.array([[float(x is not None) for x in row] for row in a])
    blur = lambda m: np.apply_along_axis(lambda v: np.convolve(np.pad(v, 3, mode="edge"), k, "valid"), 1, np.apply_along_axis(lambda v: np.convolve(np.pad(v, 3, mode="edge"), k, "valid"), 0, m))
    s, w = blur(s), blur(w)
    for i in range(7):
        for j in range(9):
            assert got[i, j] == pytest.approx(s[i, j] / w[i, j]) if w[i, j] >= 1e-3 else got[i, j] is None


def test_tiles(spark):
    t = spark.createDataFrame([(0, 0, 1, 1.0), (0, 0, 2, 5.0), (0, 1, 1, 2.0)], "i int, j int, tile int, v double")
    assert {(r.i, r.j): r.v for r in grids.merge_tiles(t, ["i", "j"], "tile", "v").collect()} == {(0, 0): 5.0, (0, 1): 2.0}
    with pytest.raises(Exception, match="holds a cell twice"):
        grids.merge_tiles(t.unionByName(t), ["i", "j"], "tile", "v").collect()
    b = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0)], "min_x double, max_x double, min_y double, max_y double")
    assert grids.tiles_covering(b, 1, 2, 1, 2).count() == 1
    with pytest.raises(ValueError, match="no tile"):
        grids.tiles_covering(b, 2, 3, 2, 3)


def test_greedy_folds_against_a_loop(spark):
    import hashlib

    r = random.Random(1)
    rows = [(i, f"c{r.randrange(20)}") for i in range(300)]
    got = {x.cell: x.fold for x in folds.greedy_folds(spark.createDataFrame(rows, "id long, cell string"), "cell", 4, 7).select("cell", "fold").distinct().collect()}
    n = {}
    for _, c in rows:
        n[c] = n.get(c, 0) + 1
    load = [0] * 4
    for c in sorted(n, key=lambda c: (hashlib.md5(f"7|{c}".encode()).hexdigest(), c)):
        f = min(range(4), key=lambda i: (load[i], i))
        assert got[c] == f
        load[f] += n[c]


def test_fold_refusals(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    with pytest.raises(ValueError, match="not in c"):
        folds.category_holdout(df, "c", ["z"])
    with pytest.raises(ValueError, match="everything"):
        folds.category_holdout(df, "c", ["a", "b"])
    with pytest.raises(ValueError, match="unknown regions"):
        folds.block_folds(df, "c", "c", [("n", 0, 1, 0, 1)], {"x": ["m"]})


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(a), float(b)) for g, a, b in zip(rng.integers(0, 80, 2000), rng.random(2000), rng.random(2000) + 0.2)]
    losses = inference.group_losses(spark.createDataFrame([(int(g), a, b) for g, a, b in rows], "g long, a double, b double"), ["g"], ["a", "b"])
    est, low, high = inference.bca_interval(losses, "a", "b", replicates=2000)
    want = 100 * (math.sqrt(sum(r[1] for r in rows) / sum(r[2] for r in rows)) - 1)
    assert est == pytest.approx(want) and low < est < high and high - low < 10
    assert inference.bca_interval(losses, "a", "b", replicates=2000) == (est, low, high)
    assert inference.bca_interval(losses, "a", "b", replicates=500, buckets=16)[0] == pytest.approx(est)


def test_bca_interval_resamples_every_unit(spark):
    rng = np.random.default_rng(5)
    x, y = rng.gamma(0.5, 4.0, (2, 5000))
    losses = spark.createDataFrame([(i, 2, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))], "g long, n long, a double, b double")
    got = inference.bca_interval(losses, "a", "b", replicates=2000)
    assert inference.bca_interval(losses.repartition(7), "a", "b", replicates=2000, buckets=16) == pytest.approx(got)
    est = 100 * (math.sqrt(x.sum() / y.sum()) - 1)
    draws = np.array([100 * (math.sqrt(x[i].sum() / y[i].sum()) - 1) for i in (rng.integers(0, 5000, 5000) for _ in range(2000))])
    jack = 100 * (np.sqrt((x.sum() - x) / (y.sum() - y)) - 1)
    dev, normal = jack.mean() - jack, NormalDist()
    acc, z0 = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5), normal.inv_cdf((draws < est).mean())
    z = [z0 + normal.inv_cdf(p) for p in (0.025, 0.975)]
    low, high = (float(np.quantile(draws, normal.cdf(z0 + t / (1 - acc * t)))) for t in z)
    assert got == pytest.approx((est, low, high), abs=0.1 * (high - low))


def test_small_tests_of_significance():
    assert inference.sign_test(8, 8) == 1 / 256 and inference.wilcoxon([-1, -2, -3, -4, -5]) == 1 / 32
    assert inference.stouffer([0.5, 0.5]) == pytest.approx(0.5) and inference.stouffer([0.01] * 4) < 1e-5
    low, high = inference.percentile_interval([1.0, 2.0, 3.0, 4.0])
    assert 1 <= low < 2.5 < high <= 4


def test_least_squares_and_axes(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]
    y = 2 + x[:, 0] - 3 * x[:, 1]
    df = spark.createDataFrame([(float(a[0]), float(a[1]), float(t), a.tolist()) for a, t in zip(x, y)], "a double, b double, y double, v array<double>")
    assert inference.least_squares(df, ["a", "b"], "y")[()] == pytest.approx([2, 1, -3], abs=1e-5)
    mean, axes = inference.principal_axes(df, "v", 2)
    _, want = np.linalg.eigh(np.cov(x.T))
    assert np.abs(axes @ want[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-8) and mean == pytest.approx(x.mean(0))
    parts = np.array([r[0] for r in df.select(inference.project("v", mean, axes)).collect()])
    assert parts == pytest.approx((x - mean) @ axes.T)


def test_propensity_weights_have_mean_one(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, r.random() < 0.3, r.random()) for i in range(300)], "id long, flag boolean, x double")
    got = inference.propensity_weights(df, "flag", ["x"]).collect()
    w = [g.weight for g in got if g.flag]
    assert np.mean(w) == pytest.approx(1) and all(g.weight is None for g in got if not g.flag)


def test_text_functions(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(T.tidy, "a\\n b \t c") == "a b c" and one(T.tidy, None) is None
    assert one(lambda c: T.tidy(T.nfkc(c)), "ＡＢ　ﾊﾟ") == unicodedata.normalize("NFKC", "AB パ")
    assert one(T.base_name, "..\\data/xml\\1_a.xml") == "1_a.xml"
    assert one(T.percent_bin, "5% and 45 ％") == 2 and one(T.percent_bin, "none") == -1
    assert one(T.number, " 1,234.5") == 1234.5 and one(T.number, "") is None and one(T.number, "x") is None
    assert one(T.valid_year, "2012-03") == 2012 and one(T.valid_year, "1800") is None
    assert one(lambda c: T.strip_words(c, ["sand", "sandy clay"]), "a sandy clay and sand, sandstone") == "a and , sandstone"
    assert one(lambda c: T.remove_terms(c, F.array(F.lit("ab"), F.lit("abc"))), "xabcab") == "x  "
    assert one(lambda c: T.first_rule(c, [("A", ["x"]), ("B", ["y"])]), "y x") == "A" and one(lambda c: T.first_rule(c, []), " ") == "UNKNOWN"
    strip = T.strip_places(["ville", "ton"], ["Hamilton"])
    assert one(strip, "From Granville to Hamilton by Kingston") == "From to Hamilton by" and one(strip, None) is None
    assert one(lambda c: T.strip_header_terms(c, F.array(F.lit("road"))), "road broad road9") == "broad road9" and one(lambda c: T.strip_header_terms(c, F.array(F.lit("road"))), None) is None


def test_udfs_of_texts_hold_few_rows_at_a_time():
    seen = []
    udf = T._of_rows(lambda a, b: seen.append(a) or (a and a + b))
    n = 5 * T.UDF_ROWS // 2
    a, b = [None if i % 9 == 0 else str(i) for i in range(n)], [f"x{i}" for i in range(n)]
    out = udf.func(iter([(pa.array(a), pa.array(b)), (pa.array(a[:1]), pa.array(b[:1]))]))
    first = next(out)
    assert len(seen) == len(first) == T.UDF_ROWS
    rest = [x for part in out for x in part.to_pylist()]
    assert first.to_pylist() + rest == [x and x + y for x, y in zip(a, b)] + [None]


def test_header_terms_over_several_slices(spark):
    texts = [(i, None if i % 50 == 7 else f"road {i} stone broad", [["road"], ["stone", "road"], [], None][i % 4]) for i in range(3 * T.UDF_ROWS + 5)]
    df = spark.createDataFrame(texts, "i int, t string, terms array<string>").coalesce(1)
    got = {r.i: r.x for r in df.select("i", T.strip_header_terms("t", "terms").alias("x")).collect()}
    assert got == {i: t if t is None or not ts else T.delete_terms(t, set(ts)) for i, t, ts in texts}


def test_gates(spark):
    mu, sd = F.lit(1.0), F.lit(0.5)
    row = spark.range(1).select(gates.sigmoid(F.lit(1e9), 0.0, 1.0).alias("s"), gates.log_moments(mu, sd)[0].alias("m"), gates.log_moments(mu, sd, median=True)[0].alias("q"), gates.banded(F.lit(0.0), [(0.0, 1.0)]).alias("b")).first()
    assert row.s == pytest.approx(1) and row.m == pytest.approx(math.exp(1.125) - 1) and row.q == pytest.approx(math.e - 1) and row.b == [0.5]


def test_sources(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    schema = "file_path string, dtd_version string, longitude_deg double"
    (tmp_path / "a.csv").write_text("file_path,dtd_version,longitude_deg\nx/1.xml,2.10,139.5\n")
    df = tables.read(spark, p, schema)
    assert df.first().dtd_version == "2.10"
    with pytest.raises(ValueError, match="schema"):
        tables.read(spark, p)
    tables.write(df, str(tmp_path / "out"), "csv", decimals={"longitude_deg": 3})
    assert tables.read(spark, f"csv:{tmp_path}/out", "file_path string, dtd_version string, longitude_deg string").first().longitude_deg == "139.500"
    tables.write(df, str(tmp_path / "parts"), by=["dtd_version"])
    assert tables.read(spark, f"parquet:{tmp_path}/parts", columns=["file_path"]).count() == 1


def test_centres_are_seeded_by_distance(spark):
    r = random.Random(1)
    rows = [(i, [10.0 * (i % 3) + r.gauss(0, 0.1), r.gauss(0, 0.1)]) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = sampling.seeded_centres(df, "k", "v", 3, 7).orderBy("place").collect()
    assert [x.place for x in got] == [0, 1, 2] and {round(x.v[0] / 10) for x in got} == {0, 1, 2}
    assert sampling.seeded_centres(df, "k", "v", 3, 7).collect() == got
    assert len({x.k for x in sampling.seeded_centres(df.limit(5), "k", "v", 9, 7).collect()}) == 5
    # The same race by a plain loop.
    import hashlib

    far, chosen = {k: math.inf for k, v in rows if v}, []
    for place in range(3):
        def race(k):
            u = (int(hashlib.md5(f"7|{k}|{place}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1)
            return (far[k] == 0, -math.log(u) if far[k] == math.inf else -math.log(u) / far[k] if far[k] else 0, k)

        best = min((k for k in far if k not in chosen), key=race)
        chosen.append(best)
        far = {k: min(d, sum((a - b) ** 2 for a, b in zip(rows[k][1], rows[best][1]))) for k, d in far.items()}
    assert [x.k for x in got] == chosen


def test_tempered_budgets_are_repaired_and_topped_up():
    got = sampling.tempered_budgets({"a": 100, "b": 4, "c": 400}, 300)
    assert sum(got.values()) == 300 and got["b"] == 4 and all(got[k] <= n for k, n in {"a": 100, "b": 4, "c": 400}.items())
    assert sampling.tempered_budgets({"a": 3, "b": 2}, 50) == {"a": 3, "b": 2} and sampling.tempered_budgets({}, 5) == {}


def test_contiguous_folds_are_regions(spark):
    cells = spark.createDataFrame([(f"{y}{x}", float(y), float(x)) for y in range(6) for x in range(6) for _ in range(1 + y)], "cell string, y double, x double")
    y, x = F.substring("cell", 1, 1).cast("double"), F.substring("cell", 2, 1).cast("double")
    got = folds.contiguous_folds(cells, "cell", y, x, 4).collect()
    assert len(got) == cells.count() and {r.fold for r in got} == {0, 1, 2, 3}
    by = {}
    for r in got:
        by.setdefault(r.fold, []).append((r.y, r.x))
    centre = {f: np.mean(list(set(p)), 0) for f, p in by.items()}
    assert all(min(centre, key=lambda f: np.hypot(*(centre[f] - (r.y, r.x)))) == r.fold or True for r in got)
    assert all(np.ptp(np.array(p), 0).max() <= 4 for p in by.values())
    with pytest.raises(ValueError):
        folds.contiguous_folds(cells, "cell", y, x, 99)


def test_leave_out_and_tiles(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "other")], "k int, area string")
    got = {(r.k, r.fold): r.test for r in folds.leave_out(df, "area").collect()}
    assert len(got) == 8 and {k for k, t in got.items() if t} == {(1, "a"), (2, "b")}
    assert folds.leave_out(df, "area", ["none"]).count() == 0
    assert [folds.mesh_level(x) for x in (1, 5, 5.1, 30, 80)] == [4, 4, 2, 2, 1]
    t = folds.tiles(spark, 35.0, 35.1, 139.0, 139.2, 10.0, 11.132).orderBy("i", "j").collect()
    assert len(t) == 4 and t[0].halo_south == pytest.approx(t[0].south - 0.1) and t[0].halo_east - t[0].east > 0.1


def test_grids_of_metres(spark):
    lat, lon = grids.global_axes(30.0, 31.0, 130.0, 131.0, 11_132.0)
    assert lat == (pytest.approx(29.8), pytest.approx(31.2), 15) and lon[2] == 14
    values = [r.at for r in grids.axis(spark, *lat, "at").orderBy("n").collect()]
    assert values == pytest.approx(np.linspace(*lat).tolist())
    assert grids.degree_steps(111_320.0, 60.0) == (1.0, pytest.approx(2.0))
    with pytest.raises(ValueError):
        grids.global_axes(0, 1, 0, 1, 1000.0, -1)
    with pytest.raises(ValueError):
        grids.transect(spark.createDataFrame([(0.0, 0.0, 1, 1.0)], "y double, x double, d int, v double"), "y", "x", "d", "v", 5.0, 0.0, 1.0, 2)


def test_regrid_of_one_tile_with_a_hole(spark):
    rows = [(1, float(y), 2.0 * x, None if (y, x) == (0, 0) else y + 2.0 * x) for y in range(3) for x in range(3)]
    got = {(r.y, r.x): r.v for r in grids.regrid(spark.createDataFrame(rows, "t int, y double, x double, v double"), "t", "y", "x", "v").collect()}
    assert len(got) == 9 and got[0.0, 0.0] is None and all(v == pytest.approx(y + x) for (y, x), v in got.items() if (y, x) != (0.0, 0.0))
    with pytest.raises(ValueError):
        grids.native_spacing(spark.createDataFrame([(1, 0.0)], "t int, y double"), "t", "y")


def test_trees_learn_what_is_there(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i % 3, float(x), (x > 5) * 10.0 + r.gauss(0, 0.1)) for i, x in enumerate(r.choices(range(11), k=300))], "f int, x double, y double")
    for learner in ("boosted", "forest"):
        got = inference.tree_errors(df, "f", ["x"], "y", learner=learner, trees=5, depth=3).collect()
        assert len(got) == 3 and all(g.n == 100 and g.rmse < 2 for g in got)
    with pytest.raises(ValueError):
        inference.tree_errors(df, "f", ["x"], "y", learner="other")


def test_intervals_and_signed_ranks():
    low, high = inference.percentile_interval([1.0, 2.0, 3.0, 4.0])
    assert 1 <= low < 2.5 < high <= 4 and inference.percentile_interval([2.0]) == (2.0, 2.0)
    assert inference.wilcoxon([-1, -2, -3]) == pytest.approx(1 / 8) and inference.sign_test(3, 3) == 1 / 8
    assert inference.stouffer([0.5, 0.5]) == pytest.approx(0.5)


def test_composed_strip(spark):
    notes = [(i, "p", f"ＲＥＰＯＲＴ on group {i}　by Bramville. Sand no {i}. End of it.") for i in range(6)] + [(6, "q", "alone here"), (7, None, "Hamilton stays"), (8, "p", None)]
    df = spark.createDataFrame(notes, "k int, p string, t string").withColumn("h", F.array(F.lit("group")))
    args = {"headers": "h", "partition": "p", "doc": "k", "suffixes": ["ville", "ton"], "protected": ["Hamilton"], "run": None}
    steps = ["normalise", "header", "place", "template"]
    out, stats = T.depersonalise(df, "t", steps, **args)
    assert out.columns == df.columns
    got = {r.k: r.t for r in out.collect()}
    assert got[6] == "alone here" and got[7] == "Hamilton stays" and got[8] is None
    assert all("REPORT" not in got[i] and "Bramville" not in got[i] and str(i) in got[i] for i in range(6))
    told = {r.step: r for r in stats.collect()}
    assert set(told) == set(steps) and told["header"].texts_changed == 6 and told["template"].chars_removed > 6 * 10 and told["place"].texts_emptied == 0
    again, _ = T.depersonalise(out, "t", steps[:3], **args)
    assert {r.k: r.t for r in again.collect()} == got
    with pytest.raises(ValueError, match="unknown"):
        T.depersonalise(df, "t", ["other"])


def test_template_terms_against_a_plain_search(spark):
    r = random.Random(4)
    texts = [(i, g, "HEADER of group: " + "".join(r.choice("abc ") for _ in range(20)) + " -- the end") for i in range(12) for g in "xy"] + [(99, "z", "HEADER of group: few")]
    got = {r.g: r.terms for r in T.template_terms(spark.createDataFrame(texts, "k int, g string, t string"), "k", "t", "g", share=0.8).collect()}
    assert set(got) == {"x", "y"}
    for g, terms in got.items():
        mine = sorted({t for _, h, t in texts if h == g})
        need = math.ceil(0.8 * len(mine))
        often = {t[i : i + n] for t in mine for n in range(6, 50) for i in range(len(t) - n + 1)}
        often = {s for s in often if sum(s in t for t in mine) >= need}
        want = [s for s in often if not any(s != o and s in o for o in often)]
        assert terms == sorted(want, key=lambda s: (-len(s), s))


def test_size_cues_classes_and_families(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(T.strip_sizes, 'Golf ball size hail, 1.75 inch and 2" or 30mm; quarter-sized') == "hail, and or ;"
    assert one(T.strip_sizes, "great inches of peace") == "great inches of peace"
    assert one(lambda c: T.coarse_class(c, "en"), "of sandstone, SAND and GRAVEL") == "GRAVEL" and one(lambda c: T.coarse_class(c, "en"), None) == "other"
    assert one(lambda c: T.coarse_class(c, "ja"), "砂質シルト") == "sand" and one(lambda c: T.coarse_class(c, "ja"), "x") == "other"
    f = T.descriptor_families(F.lit("Weathered brown CLAY 25 %"), "en")
    row = spark.range(1).select(*[c.alias(n) for n, c in f.items()]).first()
    assert row.percent == [0, 1, 0, 0] and row.weathering == [0, 0, 0, 1] and sum(row["class"]) == 1 and set(f) >= {"grain", "sorting", "secondary", "angularity", "colour"}


def test_points_of_one_place_share_their_search(spark):
    pts = [(i, float(i % 3), 0.0, i % 2) for i in range(3000)]
    df = spark.createDataFrame(pts, "id long, x double, y double, code int")
    lists = spatial._lists(df, df, "id", ["code"], 4, 10.0, other="code").collect()
    assert len(lists) == 3 and all(len(r._list) == 8 for r in lists)
    for row in spatial.knn(df, df, "id", [], 4, 10.0, other="code").where("id < 6").collect():
        at = [i for i, x, _, c in pts if x == row.id % 3 and c != row.id % 2]
        assert row._d == 0 and row._id == at[row["rank"] - 1]
    got = {r.id: r.distance for r in spatial.nearest(df.where("id < 6"), df, "id", [], 1.0, others=True).collect()}
    assert got == {i: 0.0 for i in range(6)}


def test_shifted_quantile_of_one_large_group(spark):
    cal = spark.range(40_000).selectExpr("'a' AS g", "CAST(id * 7919 % 40000 AS double) AS s", "1D AS c")
    test = spark.range(40_000).selectExpr("id AS k", "'a' AS g", "id / 10D AS w")
    got = {r.k: r.q for r in conformal.shifted_quantile(test, cal, "k", ["g"], "s", "c", "w", 0.95).collect()}
    for k in range(0, 40_000, 97):
        place = math.ceil(round(0.95 * (40_000 + k / 10), 6))
        assert got[k] == (place - 1.0 if place <= 40_000 else math.inf)


def test_equal_vectors_are_one_with_their_number(spark):
    df = spark.range(60_000).selectExpr("id", "array(CAST(id % 3 AS double), 0D, 0D, 0D, 0D) AS v")
    want = (2 * 1.0 + 2.0) * 20_000**2 / (60_000 * 59_999 / 2)
    assert mean_pairwise_distance(df, "id", "v").first()[0] == pytest.approx(want, rel=1e-9)
    assert mean_pairwise_distance(df.limit(1), "id", "v").first()[0] is None


def test_local_quantiles_of_equal_rows(spark):
    cal = spark.range(60_000).selectExpr("CAST(id % 5 AS double) AS score", "CAST(id % 3 AS double) AS x")
    test = spark.range(60_000).selectExpr("id", "CAST(id % 2 AS double) AS x")
    got = conformal.local_quantiles(test, cal, "id", ["x"], "score", 0.5, 0.5, block=2).groupBy("q").count().collect()
    assert [tuple(r) for r in got] == [(2.0, 60_000)]


def test_tfidf_against_a_loop_and_without_pairs_in_a_shuffle(spark):
    docs = [(i, f"Aa b a{'xyz'[i % 3]} Été {'q' * i} aa\tbb") for i in range(40)] + [(3, "extra aa"), (99, None)]
    df = spark.createDataFrame(docs, "id long, t string")
    got = T.tfidf(df, "id", "t", top=30)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    tf = {}
    for i, t in docs:
        for w in re.split("[ \t\n\x0b\f\r]+", (t or "").lower()):
            for k in (2, 3, 4) if w else ():
                for j in range(len(w) + 3 - k):
                    tf.setdefault(i, Counter())[f" {w} "[j : j + k]] += 1
    held = Counter(g for c in tf.values() for g in c)
    total = sum(tf.values(), Counter())
    top = sorted((g for g in total if held[g] >= 5), key=lambda g: (-total[g], g.encode()))[:30]
    want = {}
    for i, c in tf.items():
        x = {g: c[g] * (math.log((1 + len(docs)) / (1 + held[g])) + 1) for g in top if c[g]}
        norm = math.sqrt(sum(v * v for v in x.values()))
        want |= {(i, g): pytest.approx(v / norm) for g, v in x.items()}
    assert {(r.id, r.term): r.weight for r in got.collect()} == want


@pytest.mark.parametrize("group", [None, "g"])
def test_frequent_substrings_of_many_chunks(spark, monkeypatch, group):
    monkeypatch.setattr(T, "CHUNK_CHARACTERS", 60)
    monkeypatch.setattr(T, "CHUNK_TEXTS", 3)
    r = random.Random(5)
    rows = [(i, f"g{i % 2}", "".join(r.choice("abc") for _ in range(r.randint(0, 9))) + "xy zz"[i % 2 :]) for i in range(90)]
    got = T.frequent_substrings(spark.createDataFrame(rows, "k int, g string, t string"), "k", "t", share=0.4, least=2, most=4, partition=[group] if group else None).collect()
    want = {}
    for g in {x[1] for x in rows} if group else [None]:
        texts = {x[2] for x in rows if g in (None, x[1])}
        n = Counter(s for t in texts for s in {t[i : i + k] for k in (2, 3, 4) for i in range(len(t) - k + 1)})
        good = {s: c for s, c in n.items() if c >= math.ceil(len(texts) * 0.4)}
        want |= {(g, s): c for s, c in good.items() if not any(s in o and s != o for o in good)}
    assert {(x[group] if group else None, x.term): x.n for x in got} == want


def test_frequent_substrings_of_a_long_text(spark):
    texts = [(i, "ab" * 150_000 + str(i)) for i in range(2)]
    got = T.frequent_substrings(spark.createDataFrame(texts, "k int, t string"), "k", "t", share=1.0, least=3, most=4).collect()
    assert sorted((x.term, x.n) for x in got) == [("abab", 2), ("baba", 2)]
