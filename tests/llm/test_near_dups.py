import random
import re

import numpy as np
import pytest

from corelog.llm import common, near_dups

DOCS = "doc_id long, text string, lang string, sig long"


def grams(text):
    if text is None:
        return frozenset()
    w = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower()).split()
    if not w:
        return frozenset()
    n = near_dups.GRAM
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows, t):
    """Pairs between the least ids of different sets, and a pair for each copy."""
    sets = {}
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = grams(text)
        if s:
            sets.setdefault(s, {})[i, text] = i
    out = set()
    lists = [(s, list(d.values())) for s, d in sets.items()]
    for k, (s, ids) in enumerate(lists):
        out |= {(ids[0], i, 1.0) for i in ids[1:]}
        for s2, ids2 in lists[:k]:
            j = len(s & s2) / len(s | s2)
            if j >= t:
                a, b = ids[0], ids2[0]
                if b is not None and (a is None or b < a):
                    a, b = b, a
                out.add((a, b, round(j, 9)))
    return out


def corpus(seed=3, n=150):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    boiler = " ".join(r.choice(vocabulary) for _ in range(12))
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(int(len(w) * r.choice((0, 0.01, 0.03, 0.06, 0.1)))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.choice((1, 2, 3, 20, 60, 200)))))
            if r.random() < 0.4:
                texts[-1] = boiler + ".\n" + texts[-1]
    rows = [(i, t if r.random() < 0.8 else t.title() + "!", "en", 5) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, rows[3][1], None, None), (900, None, "en", 1), (901, "", "en", 1), (902, " .. !", "en", 1), (903, "x " * 20000, "en", 1), (904, "x " * 19000, None, 1)]


def classes(rows, t):
    """(doc_id, class_id, links) of each document, from all pairs."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows}, key=lambda r: (r[0], r[1], r[2] or ""))
    sets = [grams(text) for *_, text in docs]
    links, label = [0] * len(docs), list(range(len(docs)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and len(s & sets[j]) >= t * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                label[y] = x
    name = [None if no else i for no, i, _ in docs]
    return sorted(((name[i], name[find(i)], n) for i, n in enumerate(links)), key=str)


def read(df):
    assert df.columns == ["doc_id", "class_id", "links"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_matches_brute_force(spark, threshold):
    rows = corpus()
    got = read(near_dups.jaccard_classes(spark.createDataFrame(rows, DOCS).repartition(3), threshold=threshold))
    assert got == classes(rows, threshold)
    assert sum(n for *_, n in got) > 300


def test_blocks_and_dense_lists(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    monkeypatch.setattr(near_dups, "DENSE", 2)
    monkeypatch.setattr(near_dups, "HOT", 2)
    monkeypatch.setattr(near_dups, "BUCKET_CHARACTERS", 2000)
    rows = corpus(8, 90)
    assert read(near_dups.jaccard_classes(spark.createDataFrame(rows, DOCS))) == classes(rows, near_dups.THRESHOLD)


def test_a_large_cluster_makes_few_edges(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"x{r.random()}" if r.random() < 0.02 else w for w in base), "en", 1) for i in range(200)]
    _, sets, edges = near_dups.near_pairs(spark.createDataFrame(rows, DOCS))
    assert edges.count() < 4 * sets.count()
    assert read(near_dups.jaccard_classes(spark.createDataFrame(rows, DOCS))) == classes(rows, near_dups.THRESHOLD)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(5, 120)
    group = {}
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    for a, b, _ in brute(rows, near_dups.THRESHOLD):
        a, b = sorted((find(a), find(b)), key=lambda i: (i is None, i or 0))
        group[b] = a
    want = sorted((str(r) for r in rows if find(r[0]) == r[0]))
    got = near_dups.drop_near_dups(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "sig"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dups.jaccard_classes(empty).count() == 0 and near_dups.drop_near_dups(empty).count() == 0


def test_more_matches_are_asked_of_frequent_tokens():
    rare = np.array([2, 2, 2, 2, 500, 500, 500], np.uint32)
    hot = np.array([500] * 7, np.uint32)
    assert near_dups.choose_matches(10, rare, 0.8)[0] == 1
    assert near_dups.choose_matches(10, hot, 0.5)[0] > 1


def test_buckets_are_spread_over_the_partitions(spark):
    got = common.bucket_ids(spark, 95, 10)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = spark.createDataFrame([(int(i),) for i in got], "i int").selectExpr(f"pmod(hash(i), {parts}) AS p").groupBy("p").count().collect()
    assert len(got) >= 10 and len(where) == parts and len({r["count"] for r in where}) == 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(near_dups.components(edges).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
