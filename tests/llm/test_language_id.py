import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corelog.llm import language_id as li

DOCS = "doc_id long, text string, lang string, lead_ string"
SYLLABLES = {"aa": "ba be bi bo bu", "bb": "ka ke ki ko ku", "cc": "sch ung ein ver keit", "dd": "ción que los ñ el", "ee": "eau tion é le oi"}


def rows(n, languages, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(languages)
        out.append((i, " ".join("".join(r.choice(SYLLABLES[s].split()) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 40))), s, "x"))
    return out


def test_codewords_are_apart():
    assert li.codewords(1).shape == (1, 1)
    for n in (2, 3, 4, 7, 20):
        m = li.codewords(n)
        apart = (m[:, None] != m[None]).sum(2) + 99 * np.eye(n, dtype=int)
        assert apart.min() >= (m.shape[1] + 1) // 2 if n <= 4 else apart.min() >= m.shape[1] // 5
        assert (np.abs(m.sum(0)) < n).all()


def test_decoding_is_the_least_weighted_loss():
    r = np.random.default_rng(2)
    code = li.codewords(7)
    margins, trust = r.normal(size=(50, code.shape[1])), r.uniform(0.1, 2, code.shape)
    best, lead = li.decode(margins, code, trust)
    for i in range(50):
        loss = [sum(t * np.log1p(np.exp(-m * b)) for m, b, t in zip(margins[i], word, w)) for word, w in zip(code, trust)]
        assert best[i] == int(np.argmin(loss)) and lead[i] >= 0
    even = np.ones(code.shape)
    assert list(li.decode(code * 3.0, code, even)[0]) == list(range(7))
    broken = code * 3.0
    broken[:, 0] *= -1  # one wrong classifier is corrected
    assert list(li.decode(broken, code, even)[0]) == list(range(7))


def test_bits_that_fail_on_a_language_count_less():
    code = li.codewords(3)
    y = np.repeat([0, 1], 40)
    margins = code[y].astype(float)
    margins[:40, 1] *= np.where(np.arange(40) % 2, 1, -1)  # bit 1 is a coin's throw on language 0
    trust = li.bit_trust(margins, y, code)
    assert np.allclose(trust.mean(1), 1) and trust[0, 1] < 0.1 * trust[0, 0]
    assert np.allclose(trust[1], 1) and np.allclose(trust[2], 1)
    # Two languages as near as each other by plain losses: the trusted bits decide.
    wrong = code[[0]].astype(float)
    wrong[:, 1] *= -8
    assert li.decode(wrong, code, np.ones(code.shape))[0][0] != 0 and li.decode(wrong, code, trust)[0][0] == 0


def test_grams_do_not_depend_on_neighbours():
    texts = ["Über den", None, "", "ab, CD  ef!", "x"]
    buckets, bounds = li.gram_buckets(pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = li.gram_buckets(pa.array([t], pa.string()))
        assert sorted(buckets[bounds[i] : bounds[i + 1]]) == sorted(alone)


@pytest.mark.parametrize("languages", [["aa", "bb"], list(SYLLABLES)])
def test_held_out_accuracy(spark, languages):
    model = li.train(spark.createDataFrame(rows(300, languages, 1), DOCS), per_language=50)
    data = rows(200, languages, 2)
    mixed = [(900 + i, a[1] + " " + b[1], None, "m") for i, (a, b) in enumerate(zip(data, data[1:])) if a[2] != b[2]]
    odd = [(800, None, "aa", None), (801, "", "aa", "x"), (802, "12 34 !!", "aa", "x"), (None, "ba be bi " * 20000, "aa", "x")]
    got = li.identify(spark.createDataFrame(data + odd + mixed, DOCS), model).collect()
    clean = got[:200]
    assert np.mean([r["lang"] == r["language"] for r in clean]) > 0.97
    assert [r["language"] for r in got[200:204]] == [None, None, None, "aa"]
    assert [r["ambiguous"] for r in got[200:203]] == [True] * 3 and got[200]["lead"] is None
    assert np.mean([r["lead"] for r in got[204:]]) < np.mean([r["lead"] for r in clean])


def test_query_on_held_out_documents(spark):
    """Trained on the documents of even id, judged by the lang column of the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    got = li.identify(docs.where("doc_id % 2 = 1"), li.train(docs.where("doc_id % 2 = 0")), keep=["lang"]).where("language IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["language"] for r in got]) > 0.9
    assert np.mean([r["lang"] == r["language"] for r in got if not r["ambiguous"]]) > 0.95


def test_copies_count_once(spark):
    some = rows(300, ["aa", "bb"], 4)
    df = spark.createDataFrame(some, DOCS)
    low = [r for s in ("aa", "bb") for r in df.where(df.lang == s).orderBy(F.xxhash64("text", F.lit(5))).limit(1).collect()]
    copies = spark.createDataFrame([(1000 + i, r.text, r.lang, "x") for r in low for i in range(2000)], DOCS)
    one, other = li.train(df, per_language=30), li.train(df.unionByName(copies), per_language=30)
    assert one.languages == other.languages and np.array_equal(one.weight, other.weight) and np.array_equal(one.bias, other.bias)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "text", None, "x")], DOCS)
    model = li.train(df)
    assert model.languages == ()
    assert li.identify(df, model).collect()[0]["language"] is None
    assert li.identify(spark.createDataFrame([], DOCS), model).count() == 0
    with pytest.raises(ValueError):
        li.identify(df, model, language="LANG")
