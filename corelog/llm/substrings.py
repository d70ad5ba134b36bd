"""Substring dedup by super-k-mer partitioning (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelog.llm.common import _powers, bucket_ids, fresh, mix, ngrams, pack, row_key, scratch, slices, small, squeeze, unpack, unsqueeze, utf8, words, written
from corelog.plans.ship import ship

#: Words of a window: a passage of at least so many words that stands in two documents is found.
WINDOW = 50
#: Words of the runs among which a window's minimiser is chosen.
RUN = 6

#: Texts of about so many bytes are sent together: more compress better, fewer take less memory.
SEND_BYTES = 8_000_000

#: A string with more occurrences in a batch sends two of them to its bucket; the others wait elsewhere for what is found.
HOT = 64
#: One bucket takes the strings of about so many characters of text.
BUCKET_CHARACTERS = 10_000_000

_SENT = "bucket int, n int, n_texts int, lengths binary, packed binary, packed_size int, which binary, doc_key binary, doc_id binary, has_id binary, start binary, hot binary"
#: What a bucket gives: stretches of occurrences (name NULL), stretches of named strings (doc_key NULL), occurrences that wait for those.
_FOUND = "doc_key long, doc_id long, start_word int, end_word int, first boolean, name binary"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words from prefix sums: constant work a window, whatever k is."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes))
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up, out=total[1:])
    m = len(hashes) - k + 1
    return mix((total[k:] - total[:m]) * down[:m])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def super_kmers(hashes: np.ndarray, bounds: np.ndarray, k: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser) of each stretch of consecutive windows of one text that share a minimiser.

    bounds: index of each text's first word, and the end. A window is named by its first word.
    """
    empty = np.zeros(0, np.int64)
    if len(hashes) < k:
        return empty, empty, np.zeros(0, np.uint64)
    least = _sliding_min(ngrams(hashes, run), k - run + 1)
    valid = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(bounds)
    long = sizes >= k
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, np.minimum(bounds[1:][long] - k + 1, len(least)), -1)
    ok = np.cumsum(valid[:-1]) > 0
    begins = ok.copy()
    begins[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    head = bounds[:-1][long]
    begins[head] = True
    first = np.flatnonzero(begins)
    ends = ok.copy()
    ends[:-1] &= ~ok[1:] | begins[1:]
    return first, np.flatnonzero(ends), least[first]


def _name(piece: bytes) -> bytes:
    return xxhash.xxh3_128_digest(piece)


def _send(buckets: np.ndarray, most: int, text: str, key: str, doc: str):
    """mapInArrow function: a row for each (batch, bucket) with all super-k-mers that go there, and a row with all
    occurrences of the batch that wait."""
    parts = len(buckets)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(batch.schema.get_field_index(text)), SEND_BYTES):
                yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() * 31 if context else 0
        for turn, batch in enumerate(pieces(batches)):
            col = lambda b, c: b.column(b.schema.get_field_index(c))
            texts: dict[int, list[bytes]] = {}
            seen: dict[int, dict[bytes, int]] = {}
            which: dict[int, list[int]] = {}
            rows: dict[int, list[np.ndarray]] = {}
            for a, b in slices(col(batch, text)):
                part = batch.slice(a, b - a)
                data, offsets = utf8(col(part, text))
                starts, ends, hashes, bounds = words(data, offsets)
                first, last, least = super_kmers(hashes, bounds)
                if not len(first):
                    continue
                raw = data.tobytes()
                owner = np.searchsorted(bounds, first, side="right") - 1
                bucket = (least % np.uint64(parts)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ids = col(part, doc)
                here = np.stack([np.asarray(col(part, key))[owner], np.asarray(ids.fill_null(0))[owner], np.asarray(ids.is_valid())[owner].astype(np.int64), first - bounds[owner]])
                lo, hi = starts[first].tolist(), ends[last + WINDOW - 1].tolist()
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for i, j in zip(at, [*at[1:], len(order)], strict=True):
                    k, pick = int(bucket[order[i]]), order[i:j]
                    t, s, w = texts.setdefault(k, []), seen.setdefault(k, {}), which.setdefault(k, [])
                    for p in pick.tolist():
                        piece = raw[lo[p] : hi[p]]
                        n = s.setdefault(piece, len(t))  # equal strings travel once
                        if n == len(t):
                            t.append(piece)
                        w.append(n)
                    rows.setdefault(k, []).append(here[:, pick])
            if not texts:
                continue
            out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
            waiting: list[np.ndarray] = []
            names: list[bytes] = []
            for k, t in texts.items():
                r, what = np.concatenate(rows[k], 1), np.array(which[k], np.int64)
                what, r, apart = _two_of_many(what, r, len(t), most)
                hot = np.zeros(len(t), np.uint8)
                if apart is not None:
                    hot[np.unique(apart[0])] = 1
                    waiting.append(np.concatenate([apart[0][None] + len(names), apart[1]]))
                    names += [_name(x) if h else b"" for x, h in zip(t, hot.tolist(), strict=True)]
                blob = b"".join(t)
                for c, x in (
                    ("bucket", int(buckets[k])), ("n", r.shape[1]), ("n_texts", len(t)), ("lengths", pack(np.array([len(x) for x in t], np.uint32))),
                    ("packed", squeeze(blob)), ("packed_size", len(blob)), ("which", pack(what.astype(np.uint32))),
                    ("doc_key", pack(r[0])), ("doc_id", pack(r[1])), ("has_id", pack(r[2].astype(np.uint8))), ("start", pack(r[3].astype(np.uint32))), ("hot", pack(hot)),
                ):
                    out[c].append(x)
            if waiting:
                w = np.concatenate(waiting, 1)
                used, which_name = np.unique(w[0], return_inverse=True)
                blob = b"".join(names[i] for i in used.tolist())
                home = int(buckets[(number + turn) % parts])
                for c, x in (
                    ("bucket", home), ("n", w.shape[1]), ("n_texts", len(used)), ("lengths", None), ("packed", blob), ("packed_size", len(blob)), ("which", pack(which_name.astype(np.uint32))),
                    ("doc_key", pack(w[1])), ("doc_id", pack(w[2])), ("has_id", pack(w[3].astype(np.uint8))), ("start", pack(w[4].astype(np.uint32))), ("hot", None),
                ):
                    out[c].append(x)
            types = {"bucket": pa.int32(), "n": pa.int32(), "n_texts": pa.int32(), "packed_size": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.binary())) for c, v in out.items()], list(out))

    return run


def _two_of_many(what: np.ndarray, r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """Strings and occurrences (rows: doc_key, doc_id, has_id, start) that go to the bucket, and those that wait.

    Of a string with more than `most` occurrences go the first, in the order that decides which is the first, and one of another
    document: so the bucket knows of two documents, if there are, and of the first. All others of it wait.
    """
    many = np.bincount(what, minlength=n) > most
    if not many.any():
        return what, r, None
    order = np.lexsort((r[3], r[0], r[1], 1 - r[2], what))
    what, r = what[order], r[:, order]
    # A repeated row of a document is no other occurrence.
    new = np.ones(len(what), bool)
    new[1:] = (what[1:] != what[:-1]) | (r[:, 1:] != r[:, :-1]).any(0)
    what, r = what[new], r[:, new]
    head = np.concatenate([[True], what[1:] != what[:-1]])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    other = np.flatnonzero(r[0] != r[0][lead])
    stay = head | ~many[what]
    stay[other[np.unique(what[other], return_index=True)[1]]] = True
    return what[stay], r[:, stay], (what[~stay], r[:, ~stay])


def _found(doc_key, doc_id, has_id, start, end, first, name) -> pa.Table:
    columns = [doc_key, pa.array(doc_id, pa.int64(), mask=has_id == 0) if doc_id is not None else None, start, end, first, name]
    n = max(len(c) for c in columns if c is not None)
    return pa.Table.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, _TYPES, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])


def _count(table: pa.Table) -> pa.Table:
    """One bucket: its stretches of windows that stand in two documents or more, and what waits here as it is."""
    rows = table.to_pylist()
    out = [_count_windows([r for r in rows if r["lengths"] is not None])] if any(r["lengths"] is not None for r in rows) else []
    for r in rows:
        if r["lengths"] is None:
            which = unpack(r["which"], r["n"], np.uint32).tolist()
            key, doc_id, has_id, start = (unpack(r[c], r["n"], t) for c, t in (("doc_key", np.int64), ("doc_id", np.int64), ("has_id", np.uint8), ("start", np.uint32)))
            names = [r["packed"][16 * i : 16 * i + 16] for i in range(r["n_texts"])]
            out.append(_found(key, doc_id, has_id, start.astype(np.int32), None, None, [names[i] for i in which]))
    return pa.concat_tables(out)


def _count_windows(rows: list[dict]) -> pa.Table:
    """Sorts a bucket's windows; the stretches of windows that stand in two documents or more."""
    pieces: dict[bytes, int] = {}
    named: set[int] = set()
    what, doc_key, doc_id, has_id, start = [], [], [], [], []
    for r in rows:
        lengths = unpack(r["lengths"], r["n_texts"], np.uint32)
        blob = unsqueeze(r["packed"], r["packed_size"])
        ends = np.cumsum(lengths.astype(np.int64)).tolist()
        number = np.array([pieces.setdefault(blob[i:j], len(pieces)) for i, j in zip([0, *ends[:-1]], ends, strict=True)], np.int64)
        named.update(number[unpack(r["hot"], r["n_texts"], np.uint8) == 1].tolist())
        what.append(number[unpack(r["which"], r["n"], np.uint32)])
        for to, c, t in ((doc_key, "doc_key", np.int64), (doc_id, "doc_id", np.int64), (has_id, "has_id", np.uint8), (start, "start", np.uint32)):
            to.append(unpack(r[c], r["n"], t))
    what, doc_key, doc_id, has_id, start = map(np.concatenate, (what, doc_key, doc_id, has_id, start))
    start = start.astype(np.int64)
    n = len(pieces)
    # Occurrences by string, in the order that decides which is the first: NULL ids last, then id, key and place.
    order = np.lexsort((start, doc_key, doc_id, 1 - has_id, what))
    what, doc_key, doc_id, has_id, start = (x[order] for x in (what, doc_key, doc_id, has_id, start))
    other = np.ones(len(what), bool)  # a repeated row is one document
    other[1:] = (what[1:] != what[:-1]) | (doc_key[1:] != doc_key[:-1]) | (start[1:] != start[:-1])
    what, doc_key, doc_id, has_id, start = (x[other] for x in (what, doc_key, doc_id, has_id, start))
    at = np.searchsorted(what, np.arange(n + 1))
    least_key, most_key = np.minimum.reduceat(doc_key, at[:-1]), np.maximum.reduceat(doc_key, at[:-1])

    strings = pa.array(pieces, pa.binary())
    names = {i: _name(strings[i].as_py()) for i in named}
    pieces.clear()
    hash_parts, gram_parts, counts = [], [], np.zeros(n, np.int64)
    for a, b in slices(strings):
        _, _, h, bounds = words(*utf8(strings.slice(a, b - a).cast(pa.large_binary())))
        counts[a:b] = np.diff(bounds) - WINDOW + 1
        inside = np.repeat(bounds[:-1] - np.cumsum(counts[a:b]) + counts[a:b], counts[a:b]) + np.arange(counts[a:b].sum())
        hash_parts.append(h)
        gram_parts.append(window_hashes(h, WINDOW)[inside])
    del strings
    hashes, grams = np.concatenate(hash_parts), np.concatenate(gram_parts)
    hash_parts.clear()
    gram_parts.clear()
    bounds = np.concatenate([[0], np.cumsum(counts + WINDOW - 1)])
    string = np.repeat(np.arange(n), counts)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = bounds[string] + offset
    by = np.argsort(grams, kind="stable")
    sorted_grams = grams[by]
    new = np.ones(len(by), bool)
    new[1:] = sorted_grams[1:] != sorted_grams[:-1]
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    owner = string[by]
    repeated = np.minimum.reduceat(least_key[owner], heads) != np.maximum.reduceat(most_key[owner], heads)
    chosen = np.flatnonzero(repeated[group])
    if not len(chosen):
        return pa.Table.from_arrays([pa.array([], t) for t in _TYPES], [c.split()[0] for c in _FOUND.split(", ")])
    chosen, group = _exact(by, chosen, group, heads, place, hashes, least_key, most_key, string)
    # The first occurrence of each window among the first ones of the strings that hold it.
    s, g, o = string[by[chosen]], group, offset[by[chosen]]
    f = at[:-1][s]
    rank = np.lexsort((start[f] + o, doc_key[f], doc_id[f], 1 - has_id[f], g))
    lead = np.ones(len(rank), bool)
    lead[1:] = g[rank][1:] != g[rank][:-1]
    is_first = np.zeros(len(rank), bool)
    is_first[rank[lead]] = True
    # Consecutive repeated windows of a string are one stretch, cut where the first occurrence changes.
    order = np.lexsort((o, s))
    s, o, is_first = s[order], o[order], is_first[order]
    cut = np.ones(len(s), bool)
    cut[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1) | (is_first[1:] != is_first[:-1])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(s)) - 1
    s, lo, hi, is_first = s[begin], o[begin], o[end] + WINDOW, is_first[begin]
    times = at[s + 1] - at[s]
    stretch = np.repeat(np.arange(len(s)), times)
    nth = np.arange(len(stretch)) - np.repeat(np.cumsum(times) - times, times)
    occ = at[s][stretch] + nth
    here = _found(doc_key[occ], doc_id[occ], has_id[occ], (start[occ] + lo[stretch]).astype(np.int32), (start[occ] + hi[stretch]).astype(np.int32), is_first[stretch] & (nth == 0), None)
    told = np.array([i in names for i in s.tolist()], bool) if names else np.zeros(len(s), bool)
    if not told.any():
        return here
    there = _found(None, None, None, lo[told].astype(np.int32), hi[told].astype(np.int32), None, [names[i] for i in s[told].tolist()])
    return pa.concat_tables([here, there])


def _exact(by, chosen, group, heads, place, hashes, least_key, most_key, string):
    """Splits groups whose windows differ in a word although their hashes are equal; (windows, groups) that are still repeated."""
    group = group[chosen]
    differ = np.zeros(len(chosen), bool)
    for a in range(0, len(chosen), 1 << 20):
        mine, other = place[by[chosen[a : a + (1 << 20)]]], place[by[heads[group[a : a + (1 << 20)]]]]
        bad = np.zeros(len(mine), bool)
        for i in range(WINDOW):
            bad |= hashes[mine + i] != hashes[other + i]
        differ[a : a + (1 << 20)] = bad
    if not differ.any():
        return chosen, group
    mixed = np.flatnonzero(np.isin(group, np.unique(group[differ])))
    kinds: dict[tuple, int] = {}
    names = np.array([kinds.setdefault((g, hashes[p : p + WINDOW].tobytes()), len(kinds)) for g, p in zip(group[mixed].tolist(), place[by[chosen[mixed]]].tolist(), strict=True)])
    group = group.copy()
    group[mixed] = group.max() + 1 + names
    keys = string[by[chosen]]
    _, inverse = np.unique(group, return_inverse=True)
    low, high = np.full(inverse.max() + 1, np.iinfo(np.int64).max), np.full(inverse.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, least_key[keys])
    np.maximum.at(high, inverse, most_key[keys])
    stay = (low != high)[inverse]
    return chosen[stay], group[stay]


def find_repeats(df: DataFrame, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word, first): all stretches of words, each of WINDOW or more, that stand in two documents or more.

    Words are what white space parts; all windows of WINDOW words of whole texts take part. first: whether the stretch is
    the first occurrence of its windows (least doc_id, then place), which a dedup keeps. Stretches of a document with equal
    `first` that touch or overlap are merged; end_word is exclusive.

    Each text is read once. What is shuffled are super-k-mers: a stretch of consecutive windows with the same minimiser as
    one string, to the bucket of the minimiser, so all copies of a window meet in one bucket and each word travels about
    three times instead of WINDOW times. There the windows are sorted and counted exactly. There are as many buckets as the
    corpus's characters ask for. Of a string that very many documents hold, two occurrences a batch go to the bucket; the
    others are joined to what is found of it, by its 128-bit hash, so a passage of a third of all documents is many tasks'
    work.

    Rows with equal doc_id and text are one document. A window that stands twice in one document only isn't reported.
    NULL text, and texts under WINDOW words, give no rows. NULL doc_id is kept as NULL and comes after all others. An
    empty table gives an empty result. Extra columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    source = df.select(F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), row_key(doc, text).alias("doc_key"))
    with scratch(spark):
        return written(_stretches(spark, source), "repeats", stays=True)


def _stretches(spark: SparkSession, source: DataFrame) -> DataFrame:
    buckets = bucket_ids(spark, source.agg(F.sum(F.length("text"))).first()[0] or 0, BUCKET_CHARACTERS)
    sent = source.mapInArrow(_send(buckets, HOT, "text", "doc_key", "doc_id"), _SENT)
    met = written(sent.groupBy("bucket").applyInArrow(_count, _FOUND), "met")
    told = met.where("doc_key IS NULL").groupBy("name").agg(F.collect_set(F.struct(F.col("start_word").alias("lo"), F.col("end_word").alias("hi"))).alias("spans"))
    told = small(written(told, "told"), 1 + F.size("spans"))
    waiting = met.where("name IS NOT NULL AND doc_key IS NOT NULL").select("name", "doc_key", "doc_id", "start_word")
    waiting = waiting.join(told, "name").withColumn("s", F.explode("spans"))
    waiting = waiting.select("doc_key", "doc_id", (F.col("start_word") + F.col("s.lo")).alias("start_word"), (F.col("start_word") + F.col("s.hi")).alias("end_word"), F.lit(False).alias("first"))
    found = met.where("name IS NULL").drop("name").unionByName(waiting).distinct()
    w = Window.partitionBy("doc_key", "first").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(reach >= F.col("start_word"), 0).otherwise(1))
    marked = marked.withColumn("nth", F.sum("new").over(w))
    return marked.groupBy("doc_key", "doc_id", "first", "nth").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).select("doc_id", "start_word", "end_word", "first", "doc_key")


def drop_repeats(df: DataFrame, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """df with the words taken out of `text` that repeat an earlier document's passage; the first occurrence stays.

    Words that stay keep the white space before them. Cases are as in find_repeats; NULL texts stay NULL, a document that
    repeats others throughout becomes ''. Extra columns pass through, whatever their names.
    """
    key, spans = fresh(df, "key", "spans")
    repeats = find_repeats(df, text=text, doc=doc).where(~F.col("first"))
    gone = repeats.groupBy(F.col("doc_key").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    joined = df.withColumn(key, row_key(doc, text)).join(gone, key, "left").drop(key)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for i, cut in enumerate(batch.column(batch.schema.get_field_index(spans)).to_pylist()):
                if not cut:
                    continue
                raw = texts[i].encode()
                starts, ends, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                edges = np.concatenate([[0], ends])
                stay = np.ones(len(ends), bool)
                for x in cut:
                    stay[x["start_word"] : x["end_word"]] = False
                texts[i] = b"".join(raw[edges[k] : ends[k]] for k in np.flatnonzero(stay)).strip().decode()
            cols = [pa.array(texts, batch.schema.field(text).type) if c == text else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, df.schema)


#: find_repeats() over documents in DuckDB, for its default window.
FIND_SQL = r"""
WITH cut AS (
    SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0b\x0c\r\x1c-\x20]+'), lambda x: x <> '') AS ws
    FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), windows AS (
    SELECT k, doc_id, generate_subscripts(hs, 1) - 1 AS p, unnest(hs) AS h
    FROM (SELECT k, doc_id, list_transform(range(0, len(ws) - 49), lambda p: md5(array_to_string(ws[p + 1 : p + 50], ' '))) AS hs FROM cut)
), repeated AS (
    SELECT w.*, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, p) = 1 AS first
    FROM windows w SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(DISTINCT k) > 1) USING (h)
), parted AS (
    SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY k, first ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM repeated
), named AS (
    SELECT *, sum(new) OVER (PARTITION BY k, first ORDER BY p) AS nth FROM parted
)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + 50 AS INTEGER) AS end_word, first FROM named GROUP BY k, doc_id, first, nth"""
