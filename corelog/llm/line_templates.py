"""Line dedup by a log-template tree (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelog.llm.common import fresh, row_key, scratch, small, written
from corelog.plans.ship import ship

#: Leading tokens on a path of the tree, below the token count.
DEPTH = 3
#: Lines of one leaf are of one template if at least this share of their tokens, by place, is equal.
SIMILARITY = 0.6
#: A template that stands in so many documents is dropped from all but the first of them.
MIN_DOCS = 5
#: What stands for a variable field.
FIELD = "<*>"

_FOUND = "leaf long, line string, first_key long"


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\r]+", " "))


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[ \\t\\r]+", " "), "\n"), F.trim)


def _lines(text: Column) -> Column:
    """Array of (line, tokens, whole) of a text's lines: white space as one space, a token with a digit in it is a variable
    field. A line of fields alone would equal any other of its width: it stays as it is, and is `whole`.

    The whole text is masked at once. A match begins where a token does and never steps back, so that long tokens take
    linear time.
    """
    masked = F.regexp_replace(text, "(?<![^ \\t\\r\\n])[^ \\t\\r\\n0-9]*+[0-9][^ \\t\\r\\n]*+", FIELD)
    pair = F.zip_with(_trimmed(masked), F.split(text, "\n"), lambda x, raw: F.struct(x.alias("x"), raw.alias("raw"), x.rlike("^<\\*>(?: <\\*>)*+$").alias("whole")))
    line = F.transform(pair, lambda p: F.struct(F.when(p["whole"], _spaced(p["raw"])).otherwise(p["x"]).alias("line"), p["whole"].alias("whole")))
    return F.transform(line, lambda p: F.struct(p["line"].alias("line"), F.split(p["line"], " ").alias("tokens"), p["whole"].alias("whole")))


def parse_leaf(lines: list[list[str]], similarity: float = SIMILARITY, times: list[int] | None = None) -> list[int]:
    """The template number of each line of one leaf; lines have equal token counts. times: how often each stands (default: once).

    Lines are taken from the most frequent to the least, equal ones together and ties in text order, so the result
    doesn't depend on the order of rows. A line joins the template with which it shares most tokens by place (a template's
    field equals anything), the oldest of those with equally many, if the share is at least `similarity` and at least one
    token is not a field; tokens that differ become fields. Otherwise it founds a template.
    """
    counts: dict[tuple[str, ...], int] = {}
    for x, n in zip(lines, times or [1] * len(lines), strict=True):
        t = tuple(x)
        counts[t] = counts.get(t, 0) + n
    order = sorted(counts, key=lambda t: (-counts[t], t))
    if len(order) == 1:
        return [0] * len(lines)
    names: dict[str, int] = {FIELD: 0}
    coded = np.array([[names.setdefault(w, len(names)) for w in t] for t in order], np.int64)
    width = coded.shape[1]
    templates = np.empty((min(64, len(order)), width), np.int64)
    n = 0
    of = {}
    for i, row in enumerate(coded):
        best = -1
        if n:
            now = templates[:n]
            equal = now == row
            score = np.where(equal.any(1) & (((now != 0) & equal).any(1)), (equal | (now == 0)).sum(1), -1)
            best = int(score.argmax())
            if score[best] < similarity * width:
                best = -1
        if best < 0:
            if n == len(templates):
                templates = np.concatenate([templates, np.empty_like(templates)])
            templates[n] = row
            best = n
            n += 1
        else:
            templates[best][templates[best] != row] = 0
        of[order[i]] = best
    return [of[tuple(x)] for x in lines]


def _recurring(min_docs: int, similarity: float):
    """Distinct lines sorted by leaf: those whose template stands in min_docs documents, with the first document that has it."""

    def leaf(lines: list[str], times: list[int], firsts: list[dict], docs: list[list[int]]) -> Iterator[tuple[str, int]]:
        template = parse_leaf([x.split(" ") for x in lines], similarity, times)
        members: dict[int, list[int]] = {}
        for i, t in enumerate(template):
            members.setdefault(t, []).append(i)
        for rows in members.values():
            # Each line names min_docs of its documents at most: enough to tell whether all of them are so many.
            if len(set().union(*(docs[i] for i in rows))) >= min_docs:
                first = min((firsts[i]["id_rank"], firsts[i]["doc_key"]) for i in rows)[1]
                for i in rows:
                    yield lines[i], first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            leaves = np.asarray(table["leaf"])
            heads = np.flatnonzero(np.concatenate([[True], leaves[1:] != leaves[:-1]])) if len(leaves) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(heads, len(leaves)))
            out: list[tuple[int, str, int]] = []
            for h, s in zip(heads.tolist(), sizes.tolist(), strict=True):
                part = table.slice(h, s)
                found = leaf(*(part[c].to_pylist() for c in ("line", "n", "first", "docs")))
                out += [(int(leaves[h]), line, first) for line, first in found]
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["leaf", "line", "first_key"])

        for batch in batches:
            leaves = np.asarray(batch.column(0))
            if not len(leaves):
                continue
            # What may go on in the next batch waits.
            start = int(np.searchsorted(leaves, leaves[-1]))
            if held and np.asarray(held[0].column(0))[0] == leaves[-1] and start == 0:
                held.append(batch)
                continue
            yield from finish(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = [batch.slice(start)]
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run


def recurring_lines(df: DataFrame, *, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_key, pos): the lines (by number, from 0) that drop_lines takes out.

    The tree's path is the token count and the first DEPTH tokens, variable fields masked, named by its hash. Lines of fewer
    tokens have a shorter path; empty lines have none. A line of fields alone is a leaf of its own, shared with equal
    lines only.

    All lines are written once, and read by column. Leaves with fewer lines than min_docs can't recur: their lines don't
    travel. Equal lines are counted before the shuffle, with their first document and min_docs of their documents, so
    a line that a third of all documents share is one row; a task parses a leaf's distinct lines. What recurs is joined to
    the written lines' hashes (of 2 x 64 bits).
    """
    ship(df.sparkSession)
    rank = F.coalesce(F.col(doc).cast("long"), F.lit(2**63 - 1))
    # What a generator returns isn't computed again by the filter and the hash above it.
    lines = df.where(F.col(text).isNotNull()).select(row_key(doc, text).alias("doc_key"), rank.alias("id_rank"), F.posexplode(_lines(F.col(text))).alias("pos", "l"))
    cut = lines.where(F.col("l.line") != "")
    path = F.when(F.col("l.whole"), F.xxhash64(F.lit(0), "l.line")).otherwise(F.xxhash64(F.size("l.tokens"), F.slice("l.tokens", 1, DEPTH)))
    cut = written(cut.select(path.alias("leaf"), F.xxhash64("l.line", F.lit(7)).alias("line_key"), "doc_key", "id_rank", "pos", "l.line"), "cut")
    leaves = written(cut.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    some = cut.join(small(leaves), "leaf", "left_semi")
    counted = some.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min(F.struct("id_rank", "doc_key")).alias("first"))
    nth = F.dense_rank().over(Window.partitionBy("leaf", "line").orderBy("doc_key"))
    docs = some.select("leaf", "line", "doc_key", nth.alias("nth")).where(F.col("nth") <= min_docs).groupBy("leaf", "line").agg(F.collect_set("doc_key").alias("docs"))
    distinct = counted.join(docs, ["leaf", "line"]).select("leaf", "line", "n", "first", "docs")
    found = distinct.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_recurring(min_docs, similarity), _FOUND)
    found = written(found.select("leaf", F.xxhash64("line", F.lit(7)).alias("line_key"), "first_key"), "recurring")
    return cut.join(small(found), ["leaf", "line_key"]).where("doc_key <> first_key").select("doc_key", "pos")


def drop_lines(df: DataFrame, *, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, text: str = "text", doc: str = "doc_id", dropped: str | None = None, n_chars: str | None = None) -> DataFrame:
    """df with the lines taken out of `text` whose template stands in min_docs documents or more.

    The first of those documents (least id, NULL last) keeps its lines of the template, so that what documents share is
    still there once; all others lose theirs, and a document that has no line of its own becomes ''. Lines are what "\\n"
    parts, whole; empty ones stay. dropped: if named, a new bigint column, the number of lines
    taken out. n_chars: if named, that column is set to the new text's length.

    NULL text stays NULL (0 lines dropped). Rows with equal id and text are one document, and lose the same lines. A
    line that recurs in one document only stays. Ties between templates go to the older one. Empty table: empty result.
    Extra columns pass through, whatever their names; a clash of `dropped` raises ValueError.
    """
    if dropped and dropped.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column exists already: {dropped}")
    key, gone = fresh(df, "key", "gone")
    with scratch(df.sparkSession):
        found = recurring_lines(df, min_docs=min_docs, similarity=similarity, text=text, doc=doc)
        by_doc = written(found.groupBy(F.col("doc_key").alias(key)).agg(F.collect_set("pos").alias(gone)), "lines", stays=True)
    by_doc = small(by_doc, 1 + F.size(gone) / 4)
    joined = df.withColumn(key, row_key(doc, text)).join(by_doc, key, "left")
    stay = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col(gone), i))
    clean = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(stay, "\n"))
    columns = [clean.alias(c) if c == text else F.length(clean).cast(df.schema[c].dataType).alias(c) if n_chars and c == n_chars else F.col(c) for c in df.columns]
    return joined.select(*columns, *([F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(dropped)] if dropped else []))
