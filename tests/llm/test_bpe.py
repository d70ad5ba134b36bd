import base64
import os
import random

import numpy as np
import pytest
import tiktoken

from corelog.llm import bpe
from corelog.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(VOCABULARY)


@pytest.fixture(scope="module")
def public():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed=1, n=300):
    r = random.Random(seed)
    words = ["the", "don't", "Straße", "naïve", "12345", "3.14", "x" * 70, "日本語", "🙂🙃", "foo_bar", "A.B.C", "…", " ", "é", "''s", "tab\tin", "'ll"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n ", "\t", " \n", "　", "\r\n", ""]
    out = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(0, 30))) for _ in range(n)]
    return [*out, "", " ", "   ", "\n", " a", "a ", "a  b", "<|endoftext|>", "ab" * 4000, "word " * 30000]


def test_same_ids_as_the_public_encoder(vocabulary, public):
    data = texts()
    ids, offsets = bpe.Encoder(vocabulary).encode(data)
    for t, a, b in zip(data, offsets, offsets[1:]):
        assert ids[a:b].tolist() == public.encode_ordinary(t), t[:60]


def test_ids_do_not_depend_on_what_was_remembered(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    data = texts(2, 60)
    once = bpe.Encoder(vocabulary)
    whole, offsets = bpe.Encoder(vocabulary).encode(data)
    for t, a, b in zip(data, offsets, offsets[1:]):
        assert once.encode([t])[0].tolist() == whole[a:b].tolist()


def naive(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_tree_merges_like_a_plain_loop():
    r = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)}
    pool = [b"a", b"b", b"c"]
    while len(ranks) < 300:
        w = r.choice(pool) + r.choice(pool)
        if w not in ranks:
            ranks[w] = len(ranks)
            pool.append(w)
    v = bpe.Vocabulary(ranks)
    words = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 60))) for _ in range(300)]
    for w, ids in zip(words, bpe.encode_words(words, v)):
        assert np.frombuffer(ids, np.int32).tolist() == naive(w, ranks)


@pytest.mark.parametrize("limits", [(64, 2048), (4, 8), (10**9, 2)])
def test_long_words_are_cut_and_merged_alone(vocabulary, public, monkeypatch, limits):
    monkeypatch.setattr(bpe, "CUT_ABOVE", limits[0])
    monkeypatch.setattr(bpe, "SCALAR_WIDTH", limits[1])
    r = random.Random(9)
    words = ["".join(r.choice(s) for _ in range(n)) for s in ("abcdefghijklmnopqrstuvwxyz", "QZXJqzxj", "a") for n in (2, 3, 65, 700, 3000)]
    for w, ids in zip(words, bpe.encode_words([w.encode() for w in words], vocabulary)):
        assert np.frombuffer(ids, np.int32).tolist() == public.encode_ordinary(w)


def test_a_word_of_80000_letters_takes_seconds_at_most(vocabulary, public):
    import time

    r = random.Random(1)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(80_000))
    began = time.process_time()
    ids = np.frombuffer(bpe.encode_words([word.encode()], vocabulary)[0], np.int32)
    assert time.process_time() - began < 5
    assert vocabulary.decode(ids, np.array([0, len(ids)]))[0].tobytes().decode() == word
    assert ids[:1000].tolist() == public.encode_ordinary(word)[:1000]


def test_round_trip_on_a_table(spark, vocabulary):
    data = [(i, t, "x") for i, t in enumerate(texts(3, 80))]
    data += [(None, "no id", None), (900, None, "x"), data[0]]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string").repartition(3)
    out = bpe.encode(df, vocabulary, same="round_trip")
    rows = out.collect()
    assert len(rows) == len(data)
    for r in rows:
        if r.text is None:
            assert r.token_ids is None and r.n_tokens is None and r.round_trip is None
        else:
            assert r.round_trip and r.n_tokens == len(r.token_ids)
    back = bpe.decode(out.select("doc_id", "text", "token_ids"), vocabulary, text="again").collect()
    assert all(r.text == r.again for r in back)


def test_cases(spark, vocabulary):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="exist already"):
        bpe.encode(df.withColumnRenamed("doc_id", "N_TOKENS"), vocabulary)
    with pytest.raises(ValueError, match="exists already"):
        bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
    odd = spark.createDataFrame([(1, [None, -1, 10**6, 64]), (2, None), (3, [])], "id long, token_ids array<int>")
    got = {r.id: r.text for r in bpe.decode(odd, vocabulary).collect()}
    assert got == {1: vocabulary.blob[vocabulary.starts[64] : vocabulary.starts[64] + 1].tobytes().decode("utf-8", "replace"), 2: None, 3: ""}
    with pytest.raises(ValueError, match="not a byte-level"):
        bpe.Vocabulary({b"a": 0})
