"""Byte-level BPE encoding and decoding (operator 1)."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corelog.llm.common import release, slices, utf8
from corelog.plans.ship import ship

#: The public pre-tokenisation pattern of 50k byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a partition's encoder remembers at most; beyond that it starts anew. Bounds memory, not results.
CACHE_WORDS = 60_000
#: And so many bytes of them.
CACHE_BYTES = 16_000_000
#: Words of more bytes are cut, before merging, where no token of the vocabulary can reach across.
CUT_ABOVE = 64
#: Words whose tree is at least so wide are merged one at a time: rows of numpy arrays would hold one word each.
SCALAR_WIDTH = 2048
_NONE = np.int64(2**62)


class Vocabulary:
    """Token bytes, and for each pair of ids the id of their joined bytes, as sorted arrays."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for b, i in ranks.items():
            tokens[i] = b
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: no token for bytes {missing[:5]}")
        self.pattern = pattern
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.size = size
        pairs = {}
        for b, i in ranks.items():
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        # Pairs of neighbouring bytes that stand inside some token.
        inside = np.ones(len(self.blob), bool)
        inside[self.starts[self.lengths > 0]] = False
        at = np.flatnonzero(inside)
        self.joined = np.zeros(1 << 16, bool)
        self.joined[self.blob[at - 1].astype(np.int64) * 256 + self.blob[at]] = True

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        """A file of lines "base64 rank" (read on the driver; executors get it by broadcast: its size is the vocabulary's)."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Ids by pair, as plain numbers: made where a very long word needs it."""
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        if not len(self.pair_keys):
            return np.full(len(left), _NONE)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of token ids, and the byte offsets that belong to the token offsets."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - ends[:-1], sizes)
        at += np.arange(ends[-1])
        return self.blob[at], ends[offsets]


def encode_words(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Token ids of each word, as bytes of int32.

    A segment tree over the byte positions of each word holds, in every node, the least (pair rank, position) below it,
    so its root is the leftmost pair of the least rank. A merge rewrites the leaves of the merged position, of its live
    left neighbour and of the position that ends: three root paths, each of logarithmic length. Words of the same tree
    width are stepped together as rows of numpy arrays; very long ones alone, by the same tree in plain numbers. Before
    that long words are cut between bytes that stand side by side in no token: no merge crosses such a place, so the parts
    merge as they would in the whole.
    """
    long = [i for i, w in enumerate(words) if len(w) > CUT_ABOVE]
    if long:
        parts: list[bytes] = []
        bounds = [0]
        for i in long:
            raw = np.frombuffer(words[i], np.uint8).astype(np.int64)
            cuts = [0, *(np.flatnonzero(~v.joined[raw[:-1] * 256 + raw[1:]]) + 1).tolist(), len(raw)]
            parts += [words[i][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            bounds.append(len(parts))
        places = {p: k for k, p in enumerate(dict.fromkeys(parts))}
        known = _encode_parts(list(places), v)
        whole = [b"".join(known[places[p]] for p in parts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        short = iter(_encode_parts([w for w in words if len(w) <= CUT_ABOVE], v))
        done = iter(whole)
        return [next(done) if len(w) > CUT_ABOVE else next(short) for w in words]
    return _encode_parts(words, v)


def _encode_parts(words: list[bytes], v: Vocabulary) -> list[bytes]:
    out = [b""] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    single = np.flatnonzero(lengths == 1)
    one = [int(i).to_bytes(4, sys.byteorder) for i in v.byte_ids]
    for i in single:
        out[i] = one[words[i][0]]
    widths = np.where(lengths > 1, 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64), 0)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        if width >= SCALAR_WIDTH:
            for i in rows:
                out[i] = _merge_one(words[i], width, v)
            continue
        step = max(1, 200_000 // width)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            for i, ids in zip(part, _merge([words[i] for i in part], width, v), strict=True):
                out[i] = ids
    return out


def _merge(words: list[bytes], width: int, v: Vocabulary) -> list[bytes]:
    n = len(words)
    # Half the memory where the nodes' numbers allow it.
    kind = np.int32 if v.size * width < 2**31 - 1 else np.int64
    none = np.iinfo(kind).max
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    # One more position on either side, so that neighbours of the ends need no special case; -1 is no token.
    ids = np.full((n, width + 2), -1, kind)
    cols = np.arange(width, dtype=kind)
    ids[:, 1:-1] = np.where(cols < lengths[:, None], v.byte_ids[raw], -1)
    after = np.tile(np.arange(1, width + 3, dtype=kind), (n, 1))
    before = np.tile(np.arange(-1, width + 1, dtype=kind), (n, 1))
    tree = np.full((n, 2 * width), none, kind)
    left, right = ids[:, 1:-1], ids[:, 2:]
    real = (left >= 0) & (right >= 0)
    ranks = v.rank(left[real].astype(np.int64), right[real].astype(np.int64))
    tree[:, width:][real] = np.where(ranks < _NONE, ranks * width + np.broadcast_to(cols, real.shape)[real], none)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[r, node] = value
        up = node >> 1
        while up[0]:
            tree[r, up] = np.minimum(tree[r, 2 * up], tree[r, 2 * up + 1])
            up = up >> 1

    def value(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        a, b = ids[r, at], ids[r, after[r, at]]
        ok = (a >= 0) & (b >= 0)
        rank = np.full(len(r), _NONE)
        rank[ok] = v.rank(a[ok].astype(np.int64), b[ok].astype(np.int64))
        return np.where(rank < _NONE, rank * width + at - 1, none).astype(kind)

    r = np.flatnonzero(tree[:, 1] < none)
    while len(r):
        root = tree[r, 1]
        at = root % width + 1
        gone = after[r, at]
        ids[r, at] = root // width
        ids[r, gone] = -2
        nxt = after[r, gone]
        after[r, at] = nxt
        before[r, nxt] = at
        put(r, gone - 1, np.full(len(r), none, kind))
        put(r, at - 1, value(r, at))
        prev = before[r, at]
        has = prev >= 1
        if has.any():
            put(r[has], prev[has] - 1, value(r[has], prev[has]))
        r = r[tree[r, 1] < none]
    live = ids[:, 1:-1] >= 0
    flat = ids[:, 1:-1][live].astype(np.int32).tobytes()
    ends = (4 * np.cumsum(live.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _merge_one(word: bytes, width: int, v: Vocabulary) -> bytes:
    """One word by the same tree as _merge, in plain numbers: a fifth of the time where a row of arrays holds one word."""
    n, none = len(word), int(_NONE)
    start = v.byte_ids[np.frombuffer(word, np.uint8)]
    ranks = v.rank(start[:-1], start[1:])
    whole = np.full(2 * width, _NONE)
    whole[width : width + n - 1] = np.where(ranks < _NONE, ranks * width + np.arange(n - 1), _NONE)
    level = width
    while level > 1:
        whole[level // 2 : level] = np.minimum(whole[level : 2 * level : 2], whole[level + 1 : 2 * level : 2])
        level //= 2
    tree, ids = array("q", whole.tobytes()), array("q", start.tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    get, size = v.pairs.get, v.size

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    def best(at: int) -> int:
        nxt = after[at]
        rank = get(ids[at] * size + ids[nxt]) if nxt < n else None
        return none if rank is None else rank * width + at

    while (root := tree[1]) < none:
        at = root % width
        gone = after[at]
        ids[at], ids[gone] = root // width, -1
        nxt = after[at] = after[gone]
        if nxt < n:
            before[nxt] = at
        put(gone, none)
        put(at, best(at))
        if at:
            put(before[at], best(before[at]))
    left = np.frombuffer(ids, np.int64)
    return left[left >= 0].astype(np.int32).tobytes()


class Encoder:
    """Encodes texts; remembers the pieces that it has met, as the bytes of their int32 ids.

    A space between two characters that are not white space always begins a word of PATTERN, and what follows doesn't
    depend on what came before. So texts are cut at such spaces and the pieces looked up whole. Memory is bounded by two
    generations: when the young one is full it becomes the old one, from which pieces that are met again move back.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.find = regex.compile(v.pattern).findall
        # With another pattern the cut at spaces need not hold; then texts are not cut.
        self.cut = v.pattern == PATTERN
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def _learn(self, missing: set[str]) -> None:
        """Puts keys that aren't in the young generation there. A key is a text's first piece after a space, or another piece without its space."""
        young, old = self.young, self.old
        back = missing & old.keys()
        for p in back:
            young[p] = old[p]
        missing -= back
        self.bytes += sum(map(len, back)) + sum(map(len, missing))
        # Letters only, after a space, are one word of PATTERN.
        plain = [p for p in missing if p.isalpha()]
        missing.difference_update(plain)
        young.update(zip(plain, encode_words([b" " + p.encode() for p in plain], self.v), strict=True))
        if missing:
            cut = [self.find(p[1:] if p[:1] == " " else " " + p) for p in missing]
            young.update(zip(missing, self._words(cut), strict=True))

    def _words(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        new = list(set(chain.from_iterable(cut)))
        get = dict(zip(new, encode_words([w.encode() for w in new], self.v), strict=True)).__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their n + 1 offsets."""
        lists = [t.split(" ") if t and self.cut and not _runs(t) else [] for t in texts]
        for x in lists:
            if x:
                x[0] = " " + x[0]
        whole = [i for i, t in enumerate(texts) if t and not lists[i]]
        missing = set(chain.from_iterable(lists)) - self.young.keys()
        if missing:
            self._learn(missing)
        get = self.young.__getitem__
        coded = [b"".join(map(get, x)) for x in lists]
        if whole:
            for i, ids in zip(whole, self._words([self.find(texts[i]) for i in whole]), strict=True):
                coded[i] = ids
        offsets = np.cumsum(np.array([0, *map(len, coded)], np.int64)) // 4
        if len(self.young) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.young, self.old, self.bytes = {}, self.young, 0
        return np.frombuffer(b"".join(coded), np.int32), offsets


_ODD = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and chr(c) not in " \n"]
_BESIDE = re.compile(r"\s |\s\Z|\A\s| \s").search


def _runs(t: str) -> bool:
    """Whether a space of t has white space or an end of t beside it."""
    if "  " in t or "\n " in t or " \n" in t or t[0] == " " or t[-1] == " ":
        return True
    return any(c in t for c in _ODD) and _BESIDE(t) is not None


def encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    *,
    text: str = "text",
    ids: str = "token_ids",
    count: str = "n_tokens",
    same: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns `keep` (all by default) and the byte-level BPE token ids of `text`. One pass, no shuffle.

    ids: array<int>, the whole text's; count: bigint, its length; same: if named, boolean, whether decoding the ids gives
    the text's bytes back. NULL text: NULL in all three. Empty text: [], 0, true. Texts of any length are encoded whole.
    Rows are independent, so ties and repeated rows stay as they are. An empty table gives an empty table. A column of df
    that has the name of a new one, in any case of letters, raises ValueError.
    """
    keep = df.columns if keep is None else keep
    new = [ids, count, *([same] if same else [])]
    clash = {c.lower() for c in keep} & {c.lower() for c in new}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    hidden = text not in keep
    source = df.select(*keep, *([text] if hidden else []))
    fields = [df.schema[c] for c in keep]
    fields += [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(count, T.LongType())]
    fields += [T.StructField(same, T.BooleanType())] if same else []
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An encoder lives as long as its partition: an idle worker remembers nothing.
        enc = Encoder(shared.value)
        for batch in batches:
            for a, b in slices(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(a, b - a)
                texts = part.column(part.schema.get_field_index(text))
                flat, offsets = enc.encode(texts.to_pylist())
                null = np.asarray(texts.is_null())
                # A NULL list is a NULL offset before the value's end.
                at = pa.array(offsets, pa.int32(), mask=np.append(null, False))
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                cols += [pa.ListArray.from_arrays(at, pa.array(flat)), pa.array(np.diff(offsets), mask=null)]
                if same:
                    back, ends = enc.v.decode(flat, offsets)
                    data, starts = utf8(texts)
                    cols.append(pa.array(_equal(back, ends, data, starts), mask=null))
                yield pa.RecordBatch.from_arrays(cols, [*keep, *new])
            release()
        del enc
        release()

    return source.mapInArrow(run, T.StructType(fields))


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """For each text, whether both byte strings are the same."""
    if len(a) == len(b) and np.array_equal(at, bt):
        differ = np.concatenate([[0], np.cumsum(a != b)])
        return differ[at[1:]] == differ[at[:-1]]
    return np.array([np.array_equal(a[i:j], b[k:m]) for i, j, k, m in zip(at[:-1], at[1:], bt[:-1], bt[1:], strict=True)], bool)


def decode(
    df: DataFrame, vocabulary: Vocabulary, *, ids: str = "token_ids", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """df's columns `keep` (all by default) and the text that the token ids stand for. One pass, no shuffle.

    NULL ids: NULL. No ids: ''. Ids that are NULL or not in the vocabulary stand for nothing. Bytes that aren't UTF-8, as ids cut inside a
    character give them, become U+FFFD. An empty table gives an empty table. A clash of names raises ValueError.
    """
    keep = df.columns if keep is None else keep
    if text.lower() in {c.lower() for c in keep}:
        raise ValueError(f"column exists already: {text}")
    source = df.select(*keep, *([] if ids in keep else [ids]))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(text, T.StringType())])
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            texts = []
            for x in col:
                if not x.is_valid:
                    texts.append(None)
                    continue
                a = np.array([i for i in x.as_py() if i is not None and 0 <= i < v.size], np.int64)
                texts.append(v.decode(a, np.array([0, len(a)]))[0].tobytes().decode("utf-8", "replace"))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], [*keep, text])

    return source.mapInArrow(run, schema)
