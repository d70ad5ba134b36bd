import base64
import os
import random
from collections import Counter

import pytest
import test_line_templates
import test_mixing
import test_near_dups
import test_quality
import tiktoken

import corpus_pipeline
from corelog.llm import bpe, line_templates, mixing, near_dups
from corelog.llm.queries import QUERIES, VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents, some of them copies, near copies and junk, and labels for half of them."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(160):
        if i % 8 == 7:
            text = " ".join("".join(r.choice("#@!$%XYZ019") for _ in range(12)) for _ in range(40))
        elif i % 8 == 5 and i > 40:
            t = rows[i - 40][1].split(" ")
            t[i // 8] = "changed"
            text = " ".join(t)
        else:
            text = " ".join(r.choice(words) for _ in range(r.randrange(30, 90))) + f"\nshared footer line number {i} of this site\n" + " ".join(r.choice(words) for _ in range(12))
        rows.append((i, text, "en", r.choice(("a", "a", "b")), len(text)))
    rows += [(900, None, "en", "a", None), (901, "", "en", "b", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 8 != 7), 0) for r in rows if r[0] // 8 % 2 == 0 or 150 < r[0] < 160], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")
def test_each_stage_works_on_what_the_one_before_kept(spark, folder):
    d, rows = folder
    junk = {r[0] for r in rows if r[0] % 8 == 7 and r[0] < 160}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns

    ranked = corpus_pipeline.quality(spark, docs, d)
    kept = {r.doc_id for r in ranked.collect()}
    assert ranked.columns == columns and not kept & junk and kept >= {r[0] for r in rows} - junk

    lines = corpus_pipeline.lines(spark, ranked, d)
    after = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns and set(after) == kept
    footers = [i for i, r in after.items() if "shared footer line" in (r.text or "")]
    assert footers == [min(kept)]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())

    one = corpus_pipeline.near_duplicates(spark, lines, d)
    left = {r.doc_id for r in one.collect()}
    copies = {i for i in kept if i % 8 == 5 and 40 < i < 160 and i - 40 in kept}
    assert one.columns == columns and not copies & left and left == kept - copies

    mixed = corpus_pipeline.mix(spark, one, d)
    used = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == columns and set(used) <= left and not {900, 901} & set(used)
    assert max(used.count(i) for i in set(used)) <= mixing.EPOCHS

    coded = corpus_pipeline.tokens(spark, mixed, d).collect()
    assert sorted(r.doc_id for r in coded) == sorted(used) and all(r.round_trip for r in coded)

    whole = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect()]
    assert sorted(whole) == sorted((r.doc_id, r.n_tokens) for r in coded)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")
def test_each_stage_equals_brute_force(spark, folder):
    """Every stage on all rows of the one before, against plain loops; the ranker's weights are its own, the rest is independent."""
    d, _ = folder
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    scored, least = test_quality.brute_ranked(spark, docs, labels)
    ranked = corpus_pipeline.quality(spark, docs, d)
    kept = {(i, t) for i, t, _ in rows(ranked)}
    assert {(i, t) for i, t, x in scored if x is None or x > least + 1} <= kept <= {(i, t) for i, t, x in scored if x is None or x >= least - 1}

    lines = corpus_pipeline.lines(spark, ranked, d)
    assert sorted(repr((i, t)) for i, t, _ in rows(lines)) == test_line_templates.brute([r[:2] for r in rows(ranked)], line_templates.MIN_DOCS)

    one = corpus_pipeline.near_duplicates(spark, lines, d)
    classes = test_near_dups.classes(rows(lines), near_dups.THRESHOLD)
    assert sorted(i for i, _, _ in rows(one)) == sorted(i for i, c, _ in classes if i == c)

    mixed = corpus_pipeline.mix(spark, one, d)
    want = Counter()
    for (t, _), n in test_mixing.brute([(i, t, s) for i, t, s in rows(one)]).items():
        want[t] += n
    assert Counter(t for _, t, _ in rows(mixed)) == want

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.tokens(spark, mixed, d).collect())
    assert got == Counter((i, tuple(public.encode_ordinary(t))) for i, t, _ in rows(mixed))


def test_ten_operators_have_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
