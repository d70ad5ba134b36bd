import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from corelog.functions import digest as D
from corelog.sources import tables as S
from corelog.sources import xml as X

DOC = """<?xml version="1.0" encoding="{enc}"?>
<!DOCTYPE d SYSTEM "x.dtd" [<!ENTITY z "y">]>
<d><!-- <l><t>no</t></l> --><e/>
<g><l><a>0</a><b>1.5</b><t> 砂 &amp;
 gravel</t></l></g>
<l><a>2</a><b>1</b><t>upside down</t></l><l><a>x</a><b>9</b><t>no bound</t></l><l><a>2</a><b>3</b><t/></l>
<l><a>2</a><b>4</b><t><![CDATA[<clay>]]></t></l>
<m><z>1</z><p>0</p><q>0</q><r>3</r><s>4</s></m><m><z>3</z><p>2</p><q>5</q><r>9</r><s>9</s></m><m><z>9</z><p>5</p></m><m><z>3</z><p>101</p></m><m><z>1</z></m><m><z/><p>3</p></m></d>"""


@pytest.fixture
def files(spark):
    rows = [(e, DOC.format(enc=e).encode(e)) for e in ("utf-8", "shift_jis")]
    rows += [("cut", b"<d><l>"), ("bytes", b"<d>\xff\xff\x00</d>"), ("none", None), ("empty", b"")]
    return spark.createDataFrame(rows, "path string, content binary")


def test_layers_of_all_encodings(files):
    got = sorted(tuple(r) for r in X.layers(files, "l", "t", "a", "b").collect())
    want = [(0, 0.0, 1.5, "砂 & gravel"), (4, 2.0, 4.0, "<clay>")]
    assert got == sorted((p, *w) for p in ("utf-8", "shift_jis") for w in want)


def test_records_and_elements(files):
    got = {r.path: (r.n_layers, r.text) for r in X.records(files, "l", "t").collect()}
    assert got["utf-8"] == got["shift_jis"] == (4, "砂 & gravel || upside down || no bound || <clay>")
    assert {got[p] for p in ("cut", "bytes", "none", "empty")} == {(0, "")}
    rows = X.elements(files, "l", {"low": "a", "words": "t"}).where("path = 'utf-8'").orderBy("place").collect()
    assert [tuple(r)[1:] for r in rows][:1] == [(0, "0", "砂 & gravel")] and rows[3].words is None and len(rows) == 5


def test_measurements_take_the_first_family_that_counts(files):
    m = X.measurements(files, "m", "z", [["p", "q"], ["r", "s"]], X.layers(files, "l", "t", "a", "b"))
    assert sorted(tuple(r)[1:] for r in m.where("path = 'utf-8'").collect()) == [(1.0, 7.0, "砂 & gravel"), (3.0, 7.0, "<clay>")]


def test_ladder_gives_the_last_error():
    assert X.decode_any("砂".encode("cp932")) == "砂"
    with pytest.raises(UnicodeDecodeError):
        X.decode_any(b"\x81")


def test_tolerant_union_of_gzip_files(spark, tmp_path):
    for name, text in (("a", "x,y\n1,2.50\n"), ("b", "z,x\nq,3\n")):
        (tmp_path / f"{name}.csv.gz").write_bytes(gzip.compress(text.encode()))
    got = S.union_files(spark, [f"csv:{tmp_path}/a*.gz", f"csv:{tmp_path}/b.csv.gz", f"csv:{tmp_path}/none*.gz"], "x int, y string", tolerant=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "2.50"), (3, None)]
    with pytest.raises(FileNotFoundError):
        S.union_files(spark, [f"csv:{tmp_path}/none*.gz"], "x int", tolerant=True)


def test_content_key_is_that_of_the_joined_texts(spark):
    texts = ["b", None, "砂", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    want = hashlib.sha256("\0".join(t or "" for t in texts).encode()).hexdigest()[:16]
    assert S.content_key(df, "k", "t").first().key == want


def test_content_key_is_carried_from_task_to_task(spark, monkeypatch):
    texts = [("砂" * (i * 37 % 90), None)[i % 7 == 3] for i in range(300)]
    df = spark.createDataFrame([(i if i < 299 else None, t) for i, t in enumerate(texts)], "k int, t string").repartition(5)
    joined, steps, whole = "\0".join(t or "" for t in texts).encode(), [], S._digested

    def digested(pieces, first, last, *rest):
        steps.append((first, last))
        return whole(pieces, first, last, *rest)

    monkeypatch.setattr(S, "_digested", digested)
    assert D.can_carry()
    assert S.content_key(df, "k", "t", piece=100, step=1000).first().key == hashlib.sha256(joined).hexdigest()[:16]
    assert len(steps) >= len(joined) / 1000
    assert S.content_key(df.where("k < 0"), "k", "t").first().key == hashlib.sha256(b"").hexdigest()[:16]


def test_content_key_where_no_state_can_be_carried(spark, monkeypatch):
    whole = S._digested
    monkeypatch.setattr(S, "_digested", lambda pieces, first, last, state, begins, alone: whole(pieces, first, last, state, begins, alone) if alone else (None, None))
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "k int, t string")
    assert S.content_key(df, "k", "t", piece=10, step=100).first().key == hashlib.sha256("\0".join("x" * i for i in range(50)).encode()).hexdigest()[:16]


def test_steps_hold_no_more_than_they_may():
    sizes = [(p, i, 7) for p in (0, 2, 3) for i in range(5)] + [(4, 0, 50), (4, 1, 1)]
    steps = S.steps_of(sizes, 21)
    assert steps[0] == ((0, 0), (0, 2)) and steps[-2:] == [((4, 0), (4, 0)), ((4, 1), (4, 1))]
    held = [[s for p, i, s in sizes if a <= (p, i) <= b] for a, b in steps]
    assert sum(held, []) == [s for *_, s in sizes] and all(sum(h) <= 21 or len(h) == 1 for h in held)
    assert S.steps_of([], 21) == []


def test_digest_goes_on_from_a_state():
    d = D.Digest()
    for i in range(0, 1000, 37):
        d = D.Digest(d.state())
        d.update(bytes(1000)[i : i + 37])
        assert d.hexdigest() == hashlib.sha256(bytes(min(1000, i + 37))).hexdigest()


def test_manifest_differences(spark):
    f = lambda *rows: spark.createDataFrame([(p, c, len(c)) for p, c in rows], "path string, content binary, length long")
    listed = S.manifest(f(("same", b"1"), ("edited", b"2"), ("lost", b"3")))
    got = S.manifest_differences(f(("same", b"1"), ("edited", b"4"), ("new", b"5")), listed).collect()
    assert {tuple(r) for r in got} == {("edited", "changed"), ("lost", "missing"), ("new", "unlisted")}


def test_shards_refuse_a_key_twice(spark):
    a, b, other = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(2, 3)], "k int, v int"), spark.createDataFrame([(1,)], "x int")
    assert S.combine_shards([a, other, b], ["k"], ["k", "v"]).count() == 2
    with pytest.raises(ValueError, match="two shards"):
        S.combine_shards([a, a], ["k"], ["k", "v"])
    with pytest.raises(ValueError, match="no shard"):
        S.combine_shards([other], ["k"], ["k", "v"])
    assert S.combine_shards([spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), b], ["k"], ["k"]).count() == 3


def test_registry_and_first_existing(spark, tmp_path):
    with pytest.raises(ValueError):
        S.Registry([])
    with pytest.raises(ValueError):
        S.Registry([("a", "continuous", None), ("a", "categorical", None)])
    value = lambda v: lambda p: p.where("k < 2").select("k", F.lit(v).alias("value"))
    r = S.Registry({"a": ("continuous", value(1)), "b": ("categorical", value("x")), "c": ("continuous", value(2.5))})
    assert r.names() == ["a", "b", "c"] and r.names("categorical") == ["b"]
    p = spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(tuple(x) for x in r.stack(p, "k").collect()) == [(1, [1.0, 2.5]), (2, [None, None])]
    (tmp_path / "there").write_text("x")
    assert S.first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/there"]).endswith("there")
    with pytest.raises(FileNotFoundError):
        S.first_existing(spark, [f"{tmp_path}/no"])
