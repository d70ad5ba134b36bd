import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import pytest

from corelog.llm import mixing

DOCS = "doc_id long, text string, source string, copies long"


def cost(tokens, quotas, routed):
    """Cost of a routing: convex in each pattern's total, SHORT for each token of quota that isn't filled."""
    total = 0
    for p, n in tokens.items():
        left = sum(routed.get(p, {}).values())
        for c in mixing.COSTS:
            use = min(n, left)
            total += use * c
            left -= use
        if left:
            return None
    got = Counter()
    for x in routed.values():
        got.update(x)
    if any(got[s] > quotas.get(s, 0) for s in got):
        return None
    return total + mixing.SHORT * sum(q - got[s] for s, q in quotas.items())


@pytest.mark.parametrize("seed", range(12))
def test_route_is_optimal(seed):
    r = random.Random(seed)
    patterns = [("a",), ("b",), ("a", "b"), ("b", "c")][: r.randrange(1, 5)]
    tokens = {p: r.randrange(1, 4) for p in patterns}
    quotas = {s: r.randrange(0, 7) for s in "abc"}
    got = mixing.route(tokens, quotas)
    arcs = [(p, s) for p in patterns for s in p]
    best = None
    for x in product(*[range(quotas[s] + 1) for _, s in arcs]):
        trial = defaultdict(dict)
        for (p, s), n in zip(arcs, x):
            trial[p][s] = n
        c = cost(tokens, quotas, trial)
        best = c if best is None or c is not None and c < best else best
    assert cost(tokens, quotas, got) == best


def brute(rows, **options):
    """The selection of mix_documents by plain loops: {(doc_id, text): copies}."""
    contents = {}
    for i, t, s, *_ in rows:
        if t and t.split():
            contents.setdefault(t, {}).setdefault(s or "", []).append(i)
    patterns = defaultdict(list)
    for t, seats in contents.items():
        patterns[tuple(sorted(seats))].append(t)
    tokens = {p: sum(len(t.split()) for t in ts) for p, ts in patterns.items()}
    by = Counter()
    for p, n in tokens.items():
        for s in p:
            by[s] += n
    routed = mixing.route(tokens, mixing.quotas(dict(by), options.get("weights"), int(options.get("budget", 1.0) * sum(tokens.values()))))
    out = Counter()
    for p, ts in patterns.items():
        digest = lambda t: hashlib.md5(t.encode()).hexdigest()
        ts.sort(key=lambda t: (int(hashlib.md5(f"17|{digest(t)}".encode()).hexdigest()[:13], 16), digest(t)))
        stretches, begin = [], 0
        for s, n in sorted(routed[p].items()):
            stretches.append((s, begin, begin + n))
            begin += n
        for use in range(mixing.EPOCHS + 1):
            at = use * tokens[p]
            for t in ts:
                for s, a, b in stretches:
                    if a <= at < b:
                        out[t, s] += 1
                at += len(t.split())
    return out


def corpus():
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(r.randrange(1, 30))) + f" {i}", "big", 1) for i in range(150)]
    rows += [(200 + i, " ".join("xyz"[r.randrange(3)] for _ in range(12)) + f" {i}", "small", 1) for i in range(20)]
    rows += [(300 + i, rows[i][1], r.choice(("small", "third", None)), None) for i in range(40)]
    return rows + [rows[2], (None, "null id here", "third", 1), (900, None, "big", 1), (901, "  \n", "big", 1), (902, "w " * 3000, "third", 1)]


@pytest.mark.parametrize("options", [{}, {"weights": {"small": 0.5, "big": 0.5}}, {"budget": 0.4}])
def test_matches_plain_loops(spark, options, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mix_documents(df, copies="uses", **options)
    assert got.columns == [*df.columns, "uses"]
    want = Counter()
    for (t, _), n in brute(rows, **options).items():
        want[t] += n
    have = Counter()
    for r in got.collect():
        have[r["text"]] += r["uses"]
    assert have == want
    assert mixing.mix_documents(df, copies=None, **options).count() == sum(want.values())


def test_shares_follow_the_weights(spark):
    rows = corpus()
    weights = {"big": 0.9, "small": 0.1}
    chosen = mixing.mix(spark.createDataFrame(rows, DOCS), weights=weights, budget=0.8)
    got = brute(rows, weights=weights, budget=0.8)
    by = Counter()
    for (t, s), n in got.items():
        by[s] += n * len(t.split())
    assert chosen.groupBy("source").sum("copies").count() == 2
    assert all(abs(by[s] / sum(by.values()) - w) < 0.05 for s, w in weights.items())


def test_many_patterns_are_routed_in_a_minute():
    import time

    r = random.Random(5)
    names = [f"s{i}" for i in range(40)]
    patterns = {tuple(sorted(r.sample(names, r.randrange(1, 5)))) for _ in range(12_000)}
    tokens = {p: r.randrange(1, 10_000) for p in patterns}
    by = Counter()
    for p, n in tokens.items():
        for s in p:
            by[s] += n
    quotas = mixing.quotas(dict(by), None, sum(tokens.values()))
    began = time.process_time()
    routed = mixing.route(tokens, quotas)
    assert time.process_time() - began < 60
    got = Counter()
    for x in routed.values():
        got.update(x)
    assert got == Counter(quotas)


def test_the_row_of_the_assigned_source_stays(spark):
    rows = [(1, "one two three", "a", 7), (1, "one two three", "b", 8), (2, "four five", "a", 1), (2, "four five", "a", 1), (3, "six", "b", 2), (3, "six", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for weights in ({"a": 1.0}, {"b": 1.0}):
        want = {(r["source"], r["copies"]) for r in mixing.mix(df, weights=weights).collect()}
        got = mixing.mix_documents(df, copies="uses", weights=weights).collect()
        assert {r["source"] for r in got} == {s for s, _ in want} == set(weights)
        assert len({(r["doc_id"], r["source"]) for r in got}) == len(got)
        assert all(r["copies"] == 1 for r in got if r["doc_id"] == 3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_documents(empty, copies="n").count() == 0
    with pytest.raises(ValueError):
        mixing.mix_documents(empty, copies="Source")
