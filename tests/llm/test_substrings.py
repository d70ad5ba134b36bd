import random
from collections import defaultdict

import numpy as np
import pytest

from corelog.llm import substrings
from corelog.llm.common import words

DOCS = "doc_id long, text string, lang string, doc_key string"


def brute(rows):
    """Stretches of repeated windows by a dictionary of whole windows."""
    k = substrings.WINDOW
    docs = list(dict.fromkeys((r[0], r[1]) for r in rows if r[1] is not None))
    at = defaultdict(list)
    for d, (i, t) in enumerate(docs):
        w = t.split()
        for p in range(len(w) - k + 1):
            at[tuple(w[p : p + k])].append(((i is None, i or 0, p), d, p))
    marks = defaultdict(set)
    for places in at.values():
        if len({d for _, d, _ in places}) < 2:
            continue
        first = min(places)
        for x in places:
            marks[docs[x[1]][0], x[1], x == first].update(range(x[2], x[2] + 1))
    out = set()
    for (i, _, first), ps in marks.items():
        spans = []
        for p in sorted(ps):
            if spans and p <= spans[-1][1]:
                spans[-1][1] = p + k
            else:
                spans.append([p, p + k])
        out |= {(i, a, b, first) for a, b in spans}
    return out


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (50, 51, 80, 200)]
    rows = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice((0, 10, 49, 120, 300)))]
        for _ in range(r.randrange(3)):
            p = r.randrange(len(w) + 1)
            w[p:p] = r.choice(passages)
        rows.append((i, r.choice((" ", "\n ")).join(w), "en", "x"))
    rows += [rows[5], (70, rows[6][1], "en", None), (None, rows[6][1], None, "y"), (71, None, "en", "z"), (72, "", "en", "z")]
    rows.append((73, " ".join(["a"] * 3000), "en", "z"))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = substrings.find_repeats(spark.createDataFrame(rows, DOCS)).drop("doc_key").collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len({tuple(r) for r in got})


def test_result_does_not_depend_on_partitions(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), DOCS)
    one = sorted(map(repr, substrings.find_repeats(df.coalesce(1)).collect()))
    monkeypatch.setattr(substrings, "BUCKET_CHARACTERS", 1000)
    assert one == sorted(map(repr, substrings.find_repeats(df.repartition(7)).collect()))


@pytest.mark.parametrize("hot", [1, 2, 5])
def test_strings_of_many_documents_wait_for_what_is_found(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = corpus() + [(100 + i, corpus()[5][1], "en", "x") for i in range(20)] + [(200, " ".join(["b"] * 900), "en", "x")] * 2
    got = substrings.find_repeats(spark.createDataFrame(rows, DOCS).repartition(2)).drop("doc_key").collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len({tuple(r) for r in got})


def test_drop_of_an_empty_table_and_of_columns_that_clash(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], DOCS)).count() == 0
    p = " ".join(f"p{i}" for i in range(55))
    odd = spark.createDataFrame([(1, p, "k", "s"), (2, p, "l", "t")], "doc_id long, text string, _key string, _Spans string")
    got = substrings.drop_repeats(odd)
    assert got.columns == odd.columns and sorted(tuple(r) for r in got.collect()) == [(1, p, "k", "s"), (2, "", "l", "t")]


def test_drop_keeps_first_occurrence(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(2, f"b {p} c", "en", "k"), (1, f"a {p} d", "en", "k"), (3, "short", "en", "k"), (4, None, "en", "k"), (5, p, "en", "k")]
    got = {r["doc_id"]: r["text"] for r in substrings.drop_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[1][1], 2: "b c", 3: "short", 4: None, 5: ""}


def test_empty_table(spark):
    assert substrings.find_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    rows = corpus()[:12]
    columns = {"text": [r[1] for r in rows], "doc_key": [r[0] for r in rows], "doc_id": [r[0] for r in rows]}
    sent = list(substrings._send(np.zeros(1, int), 64, "text", "doc_key", "doc_id")(iter([substrings.pa.RecordBatch.from_pydict(columns)])))
    count = lambda: sorted(map(repr, substrings._count(substrings.pa.Table.from_batches(sent)).to_pylist()))
    want = count()
    monkeypatch.setattr(substrings, "window_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    assert want and count() == want


def test_words_and_super_kmers_cover_every_window():
    text = " ".join(map(str, range(500)))
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, h, bounds = words(data, np.array([0, len(data)]))
    first, last, least = substrings.super_kmers(h, bounds)
    assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == list(range(451))
    assert (least[1:] != least[:-1]).all()
