import random

import pytest

from corelog.llm import line_templates as lt

DOCS = "doc_id long, text string, lang string, pos int"


def masked(line):
    """(tokens, whole) of a line by its definition."""
    raw = [w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]
    out = [lt.FIELD if any(c in "0123456789" for c in w) else w for w in raw]
    return (raw, True) if out and all(w == lt.FIELD for w in out) else (out, False)


def templates(lines):
    """Template numbers by the rule's own words, one line after another; lines: [(tokens, times)] of one leaf."""
    found, of = [], {}
    for t in sorted(lines, key=lambda t: (-lines[t], t)):
        best, share = None, -1
        for k, x in enumerate(found):
            equal = [a == b for a, b in zip(x, t)]
            if any(e and a != lt.FIELD for e, a in zip(equal, x)):
                n = sum(e or a == lt.FIELD for e, a in zip(equal, x))
                if n > share:
                    best, share = k, n
        if best is None or share < lt.SIMILARITY * len(t):
            found.append(list(t))
            best = len(found) - 1
        else:
            found[best] = [a if a == b else lt.FIELD for a, b in zip(found[best], t)]
        of[t] = best
    return of


def brute(rows, min_docs):
    """Texts without the lines to drop, by grouping all lines in memory."""
    leaves = {}
    for i, text in dict.fromkeys((r[0], r[1]) for r in rows):
        for p, line in enumerate((text or "").split("\n")):
            t, whole = masked(line)
            if t:
                leaves.setdefault((whole, *t) if whole else (len(t), *t[: lt.DEPTH]), []).append((i, text, p, tuple(t)))
    gone = set()
    for lines in leaves.values():
        times = {}
        for x in lines:
            times[x[3]] = times.get(x[3], 0) + 1
        of = templates(times)
        for n in set(of.values()):
            mine = [x for x in lines if of[x[3]] == n]
            docs = {(x[0] is None, x[0] or 0, x[1]) for x in mine}
            if len(docs) >= min_docs:
                gone |= {(x[0], x[1], x[2]) for x in mine if (x[0] is None, x[0] or 0, x[1]) != min(docs)}
    return sorted(
        repr((i, text if text is None else "\n".join(line for p, line in enumerate(text.split("\n")) if (i, text, p) not in gone))) for i, text, *_ in rows
    )


def corpus(n=80):
    r = random.Random(2)
    vocabulary = [f"v{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(n):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(5))]
        for t in ("Posted by user{} on day {} here", "All rights reserved by the owner {}", "one two three four"):
            if r.random() < 0.4:
                lines.insert(r.randrange(len(lines) + 1), t.format(r.randrange(100), r.choice(vocabulary)))
        rows.append((i, "\n".join(lines), "en", 1))
    return rows + [rows[4], (None, rows[5][1], None, 2), (500, None, "en", 1), (501, "", "en", None), (502, "x y z w " * 9000, "en", 1)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = lt.drop_lines(df, min_docs=3)
    assert got.columns == df.columns
    assert sorted(repr((r[0], r[1])) for r in got.collect()) == brute(rows, 3)


def test_batches_may_cut_a_leaf(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(repr((r[0], r[1])) for r in lt.drop_lines(df, min_docs=3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, 3)


def test_counts_and_lengths(spark):
    rows = [(i, f"{chr(97 + i)} line all my own\nSent from my phone {i}", "en", 0) for i in range(6)]
    got = lt.drop_lines(spark.createDataFrame(rows, DOCS), dropped="n", n_chars="pos").orderBy("doc_id").collect()
    assert [r["n"] for r in got] == [0, 1, 1, 1, 1, 1] and got[1]["text"] == "b line all my own"
    assert [r["pos"] for r in got] == [len(r["text"]) for r in got]


def test_short_lines_recur_too(spark):
    rows = [(i, f"{chr(97 + i)} line all my own\nLes.\n\nAll rights reserved.\nPage {i}", "en", 0) for i in range(5)]
    got = [r["text"] for r in lt.drop_lines(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()]
    assert got == [rows[0][1]] + [f"{chr(97 + i)} line all my own\n" for i in range(1, 5)]


def test_number_rows_differ_by_their_numbers(spark):
    rows = [(i, f"{chr(97 + i)} line all my own\n{i} 2{i} 3{i} 4{i}\n1 2 3 {i}\n7{i}\n1\t2  3 4.5", "en", 0) for i in range(5)]
    got = [r["text"] for r in lt.drop_lines(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()]
    assert got == [rows[0][1]] + [r[1].rsplit("\n", 1)[0] for r in rows[1:]]


def test_fields_are_generalised_but_other_lines_are_not():
    lines = ["a b c start of job", "a b c start of work", "a b c no such thing", "a b c start of job"]
    assert lt.parse_leaf([x.split() for x in lines]) == [0, 0, 1, 0]


def test_empty_table(spark):
    assert lt.drop_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_a_line_of_all_documents_is_one_row(spark):
    """Whatever shares a line, the leaf's task gets it once, with MIN_DOCS of its documents."""
    rows = [(i, f"shared by all of them\nown {'x' * (i % 7)} line {chr(97 + i % 26)}{'y' * (i // 26)}", "en", 0) for i in range(120)]
    got = [r["text"].split("\n")[0] for r in lt.drop_lines(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()]
    assert got[0] == "shared by all of them" and "shared by all of them" not in got[1:]


def test_clash_of_the_count(spark):
    with pytest.raises(ValueError, match="exists already"):
        lt.drop_lines(spark.createDataFrame([], DOCS), dropped="LANG")


def test_query_against_brute_force(spark):
    from corelog.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr((r["doc_id"], r["text"])) for r in QUERIES["op9_line_templates"](spark, d).collect()) == brute(rows, lt.MIN_DOCS)
