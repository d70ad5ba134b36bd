"""N-gram Jaccard join with adaptive multi-match prefixes (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelog.llm.common import bucket_ids, fresh, mix, ngrams, pack, release, row_key, scratch, slices, small, unpack, utf8, words, written
from corelog.plans.ship import ship

#: Words of an n-gram, and the least Jaccard similarity of a pair of sets of them.
GRAM = 3
THRESHOLD = 0.5
#: A document asks for at most so many shared prefix tokens.
MOST_MATCHES = 6
#: What verifying a candidate costs, in units of one posting that is met.
VERIFY_COST = 8.0
#: Verification takes blocks of about so many sets of a cluster against each other.
BLOCK = 2048
BLOCK_TOKENS = 1_000_000
#: Posting lists longer than this first link their sets to one of them; sets that this proves near don't meet again. It
#: decides how pairs are found, not which.
DENSE = 32
#: A token of more than so many documents of a batch goes to its bucket as one number, its documents straight to the batch.
HOT = 64
#: One bucket takes the tokens of about so many characters of text.
BUCKET_CHARACTERS = 6_000_000

_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DELETED = np.isin(np.arange(256), np.frombuffer(_PUNCT, np.uint8))

_SENT = "bucket int, batch long, n int, m int, tokens binary, docs binary, df binary, meta boolean"
_LISTS = "sig long, doc_key long, doc_id long, n int, k int, tokens binary, df binary"
_POSTS = "bucket int, n_docs int, n int, sig binary, label binary, size binary, need binary, counts binary, tokens binary"
_PAIRS = "a long, b long, met int, need int"
_BIN = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def _batch(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = dict(c.split() for c in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _BIN[t]) for c, t in kinds.items()], list(kinds))


def token_bits(characters: int) -> int:
    """Bits of a token: two of all tokens of the corpus are taken for one another with a chance of about 1 in 500 each.

    Such a token only lengthens a list. For a pair of documents to share one wrongly takes both in the same two
    documents: for 1000 tokens each, a chance under 1 in 10^6.
    """
    return int(min(63, max(40, np.ceil(np.log2(max(characters, 1) / 5 + 1)) + 9)))


def gram_sets(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): each text's set of hashed word n-grams, sorted, and the n + 1 bounds.

    Words are lower-cased and have no ASCII punctuation. A text of 1 to GRAM - 1 words has one token for all of them;
    NULL texts and those without words have none.
    """
    data, offsets = utf8(pc.utf8_lower(texts))
    gone = _DELETED[data]
    offsets = offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]
    data = data[~gone]
    _, _, hashes, bounds = words(data, offsets)
    sizes = np.diff(bounds)
    grams = ngrams(hashes, GRAM)
    counts = np.where(sizes >= GRAM, sizes - GRAM + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = bounds[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    short = sizes[owner] < GRAM
    tokens = np.zeros(len(owner), np.uint64)
    tokens[~short] = grams[at[~short]]
    for i in np.flatnonzero(short):
        j = at[i]
        tokens[i] = mix(hashes[j : j + 1] * np.uint64(3) + (hashes[j + 1 : j + 2] if sizes[owner[i]] > 1 else np.uint64(1)))[0]
    tokens >>= np.uint64(64 - bits)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(sizes) + 1))


def _signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A long for each set that is equal for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(0x632BE59BD9B4E019)))])
    sums = total[bounds[1:]] - total[bounds[:-1]]
    return mix(sums + mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def _send(buckets: np.ndarray, bits: int, most: int):
    """Each batch's tokens to the buckets of their ranges, sorted and differenced; each batch's documents to any one bucket."""

    parts = len(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            all_tokens, all_docs, metas = [], [], []
            for a, b in slices(texts):
                tokens, bounds = gram_sets(texts.slice(a, b - a), bits)
                all_tokens.append(tokens)
                all_docs.append(np.repeat(np.arange(a, b), np.diff(bounds)).astype(np.uint32))
                ids = batch.column(batch.schema.get_field_index("doc_id")).slice(a, b - a)
                keys = np.asarray(batch.column(batch.schema.get_field_index("doc_key")).slice(a, b - a))
                metas.append(np.stack([_signatures(tokens, bounds), keys, np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.int64), np.diff(bounds)]))
            if not metas:
                continue
            tokens, docs = np.concatenate(all_tokens), np.concatenate(all_docs)
            place = int(len(texts) - 1).bit_length()
            if bits + place <= 64:  # both in one number sort in place
                tokens <<= np.uint64(place)
                tokens |= docs
                tokens.sort()
                docs = (tokens & np.uint64((1 << place) - 1)).astype(np.uint32)
                tokens >>= np.uint64(place)
            else:
                order = np.argsort(tokens, kind="stable")
                tokens, docs = tokens[order], docs[order]
            tokens, docs, hot = _set_apart(tokens, docs, most)
            edges = np.searchsorted(tokens, _edges(parts, bits))
            meta = np.concatenate(metas, 1)
            cols: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}

            def add(*row, cols=cols) -> None:
                for c, x in zip(cols, row, strict=True):
                    cols[c].append(x)

            home = ((number >> 24) + 7 * (number & 0xFFFFFF)) % parts
            add(int(buckets[home]), number, meta.shape[1], len(hot), pack(meta.reshape(-1)), pack(hot), None, True)
            for k in range(parts):
                t = tokens[edges[k] : edges[k + 1]]
                if len(t):
                    add(int(buckets[k]), number, len(t), 0, pack(np.diff(t, prepend=np.uint64(0))), pack(docs[edges[k] : edges[k + 1]]), None, False)
            yield _batch(_SENT, cols)
            number += 1
            del tokens, docs, all_tokens, all_docs, metas, cols
            release()

    return run


def _set_apart(tokens: np.ndarray, docs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, docs, hot) of a batch's sorted postings: a token of more than `most` documents has one entry, whose `docs` is
    their number with the highest bit set; hot: how many such tokens, the tokens, their numbers, their documents."""
    head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(tokens)))
    many = count > most
    out = np.repeat(many, count)
    hot = np.concatenate([[np.uint64(many.sum())], tokens[head[many]], count[many].astype(np.uint64), docs[out].astype(np.uint64)])
    stay = ~out
    stay[head[many]] = True
    docs = docs.copy()
    docs[head[many]] = count[many].astype(np.uint32) | np.uint32(1 << 31)
    return tokens[stay], docs[stay], hot


def _bring_back(token: np.ndarray, docs: np.ndarray, df: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings with the documents of the tokens that were set apart; all that came back from the buckets have a df."""
    apart = docs >> np.uint32(31) == 1
    if not apart.any():
        return token, docs, df
    h = int(hot[0])
    names, count, held = hot[1 : 1 + h], hot[1 + h : 1 + 2 * h].astype(np.int64), hot[1 + 2 * h :].astype(np.uint32)
    at = np.searchsorted(names, token[apart])
    begin, n = (np.cumsum(count) - count)[at], count[at]
    inside = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    return (np.concatenate([x, y]) for x, y in ((token[~apart], np.repeat(token[apart], n)), (docs[~apart], held[inside]), (df[~apart], np.repeat(df[apart], n))))


def _edges(parts: int, bits: int) -> np.ndarray:
    """Borders of `parts` equal ranges of tokens."""
    return np.array([(i << bits) // parts for i in range(parts)] + [1 << bits], np.uint64)


def _frequencies(table: pa.Table) -> pa.Table:
    """One bucket: how many documents hold each token; tokens of one document only don't travel back."""
    cols: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
    rows = table.to_pylist()
    sent = [r for r in rows if not r["meta"]]
    tokens = [np.cumsum(unpack(r["tokens"], r["n"], np.uint64)) for r in sent]
    docs = [unpack(r["docs"], r["n"], np.uint32) for r in sent]
    if sent:
        # Range buckets are sorted runs, so one stable sort merges them.
        every = np.concatenate(tokens)
        every.sort(kind="stable")
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.diff(np.append(new, len(every)))
        names = every[new]
        for t, d in zip(tokens, docs, strict=True):
            apart = d >> np.uint32(31) == 1
            np.add.at(count, np.searchsorted(names, t[apart]), (d[apart] & np.uint32(2**31 - 1)).astype(np.int64) - 1)
        names, count = names[count > 1], count[count > 1]
        del every
    for r, t, d in zip(sent, tokens, docs, strict=True):
        at = np.minimum(np.searchsorted(names, t), max(len(names) - 1, 0))
        shared = names[at] == t if len(names) else np.zeros(len(t), bool)
        if shared.any():
            df = np.minimum(count[at[shared]], 2**32 - 1).astype(np.uint32)
            row = (r["bucket"], r["batch"], len(df), 0, pack(np.diff(t[shared], prepend=np.uint64(0))), pack(d[shared]), pack(df), False)
            for c, x in zip(cols, row, strict=True):
                cols[c].append(x)
    for r in rows:
        if r["meta"]:
            for c in cols:
                cols[c].append(r[c])
    out = pa.Table.from_batches([_batch(_SENT, cols)])
    del sent, tokens, docs, rows, cols
    release()
    return out


def prefix_length(n: int, need: int, threshold: float) -> int:
    """Tokens of the prefix in which a set of n tokens shares `need` with any set of Jaccard similarity >= threshold."""
    return n - least_overlap(n, threshold) + need


def least_overlap(n: int, threshold: float) -> int:
    return int(np.ceil(threshold * n - 1e-9))


def _assemble(threshold: float):
    """One batch: a row for each document, and for each set that can have a partner its tokens that others hold, rarest first.

    Of equal sets of the batch the first row carries the tokens. Documents that can have no partner have no sig.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["meta"])
        sig, key, doc_id, has_id, size = unpack(head["tokens"], 5 * head["n"], np.int64).reshape(5, -1)
        m = len(sig)
        rest = [r for r in rows if not r["meta"]]
        tokens, frequencies, held = [None] * m, [None] * m, np.zeros(m, np.int32)
        if rest:
            token = np.concatenate([np.cumsum(unpack(r["tokens"], r["n"], np.uint64)) for r in rest])
            docs = np.concatenate([unpack(r["docs"], r["n"], np.uint32) for r in rest])
            df = np.concatenate([unpack(r["df"], r["n"], np.uint32) for r in rest])
            token, docs, df = _bring_back(token, docs, df, unpack(head["docs"], head["m"], np.uint64))
            have = np.bincount(docs, minlength=m)
            least = np.ceil(threshold * size - 1e-9).astype(np.int64)
            # With one match asked for, the prefix must reach beyond the tokens that nobody else holds.
            partner = size - least + 1 > size - have
            lead = np.zeros(m, bool)
            lead[np.unique(sig, return_index=True)[1]] = True
            held[partner] = have[partner]
            stay = (partner & lead)[docs]
            token, docs, df = token[stay], docs[stay], df[stay]
            order = np.lexsort((token, df, docs))
            token, docs, df = token[order], docs[order], df[order]
            bounds = np.searchsorted(docs, np.arange(m + 1))
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[i], bounds[i + 1]
                tokens[i], frequencies[i] = pack(token[a:b]), pack(df[a:b])
        none = held == 0
        columns = [pa.array(sig, mask=none), pa.array(key), pa.array(doc_id, mask=has_id == 0), pa.array(size.astype(np.int32)), pa.array(held), pa.array(tokens, pa.binary()), pa.array(frequencies, pa.binary())]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _LISTS.split(", ")])

    return run


def choose_matches(n: int, df: np.ndarray, threshold: float) -> tuple[int, int]:
    """(matches to ask for, prefix tokens to post) of least estimated cost.

    df: the frequencies, ascending, of the tokens that other documents hold; the other n - len(df) come before them in
    the order. With prefixes for l matches, every posting met costs 1, and at most (postings met) / l documents are met l
    times and must be verified. A longer prefix meets more postings but asks more of each candidate.
    """
    least = least_overlap(n, threshold)
    own = n - len(df)
    met = np.concatenate([[0], np.cumsum(df.astype(np.float64) - 1)])
    best = None
    for need in range(1, min(MOST_MATCHES, least) + 1):
        take = min(max(n - least + need - own, 0), len(df))
        cost = met[take] * (1 + VERIFY_COST / need)
        if best is None or cost < best[0]:
            best = (cost, need, take)
    return best[1], best[2]


def _post(buckets: np.ndarray, threshold: float):
    """Prefix tokens to the buckets of their hashes."""
    parts = len(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owner, sizes, needs, sigs, labels = [], [], [], [], [], []
            for r in batch.to_pylist():
                df = unpack(r["df"], r["k"], np.uint32)
                need, take = choose_matches(r["n"], df, threshold)
                if take:
                    tokens.append(unpack(r["tokens"], r["k"], np.uint64)[:take])
                    owner.append(np.full(take, len(sigs)))
                    sigs.append(r["sig"])
                    labels.append(r["label"])
                    sizes.append(r["n"])
                    needs.append(need)
            if not sigs:
                continue
            tokens, owner = np.concatenate(tokens), np.concatenate(owner)
            sigs, labels, sizes, needs = np.array(sigs, np.int64), np.array(labels, np.int64), np.array(sizes, np.uint32), np.array(needs, np.uint8)
            # Spread by hash here: ranges of frequent tokens would be uneven.
            bucket = (mix(tokens) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((tokens, owner, bucket))
            tokens, owner, bucket = tokens[order], owner[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(parts + 1))
            cols: dict[str, list] = {c.split()[0]: [] for c in _POSTS.split(", ")}
            for k in range(parts):
                t, o = tokens[edges[k] : edges[k + 1]], owner[edges[k] : edges[k + 1]]
                if len(t):
                    who, counts = np.unique(o, return_counts=True)
                    row = (int(buckets[k]), len(who), len(t), pack(sigs[who]), pack(labels[who]), pack(sizes[who]), pack(needs[who]), pack(counts.astype(np.uint32)), pack(t))
                    for c, x in zip(cols, row, strict=True):
                        cols[c].append(x)
            yield _batch(_POSTS, cols)

    return run


def _read_posts(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(tokens, owner, sig, label, size, need) of one bucket: postings and their documents' numbers, then a value a document."""
    tokens, owner, docs, n_docs = [], [], [], 0
    for r in table.to_pylist():
        counts = unpack(r["counts"], r["n_docs"], np.uint32)
        owner.append(np.repeat(np.arange(n_docs, n_docs + r["n_docs"]), counts))
        n_docs += r["n_docs"]
        tokens.append(unpack(r["tokens"], r["n"], np.uint64))
        docs.append([unpack(r[c], r["n_docs"], t) for c, t in (("sig", np.int64), ("label", np.int64), ("size", np.uint32), ("need", np.uint8))])
    sig, label, size, need = map(np.concatenate, zip(*docs, strict=True))
    return np.concatenate(tokens), np.concatenate(owner), sig, label, size.astype(np.int64), need.astype(np.int32)


class _Pairs:
    """Counts of pairs of numbers below n, gathered chunk by chunk."""

    def __init__(self, n: int):
        self.n, self.codes, self.counts, self.waiting, self.held = max(n, 1), np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        new = np.unique(np.minimum(i, j) * self.n + np.maximum(i, j), return_counts=True)
        self.waiting.append(new)
        self.held += len(new[0])
        if self.held > max(len(self.codes), 1_000_000):
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            self.codes, inverse = np.unique(np.concatenate([self.codes, *[c for c, _ in self.waiting]]), return_inverse=True)
            self.counts = np.bincount(inverse, np.concatenate([self.counts, *[k for _, k in self.waiting]]), len(self.codes)).astype(np.int64)
            self.waiting, self.held = [], 0

    def table(self, sig: np.ndarray, need: np.ndarray) -> pa.Table:
        self.merge()
        i, j = self.codes // self.n, self.codes % self.n
        x, y = sig[i], sig[j]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "met": self.counts.astype(np.int32), "need": np.minimum(need[i], need[j])})


def _fits(size: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9


def _meet_hubs(threshold: float, dense: int):
    """One bucket: each set of a long posting list with the one of least signature there, and how many lists say so."""

    def run(table: pa.Table) -> pa.Table:
        tokens, owner, sig, _, size, need = _read_posts(table)
        order = np.lexsort((sig[owner], tokens))
        tokens, owner = tokens[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        length = np.diff(np.append(head, len(tokens)))
        hub = np.repeat(owner[head], length)
        take = np.repeat(length > dense, length) & (hub != owner)
        i, j = hub[take], owner[take]
        ok = _fits(size, i, j, threshold)
        pairs = _Pairs(len(sig))
        pairs.add(i[ok], j[ok])
        return pairs.table(sig, need)

    return run


def _meet(threshold: float, chunk: int = 500_000):
    """One bucket: pairs of sets of different labels whose prefixes share tokens here, with how many, if their sizes allow the
    similarity. Sets of one label are passed over as a run, so a large cluster costs its length, not its square."""

    def run(table: pa.Table) -> pa.Table:
        tokens, owner, sig, label, size, need = _read_posts(table)
        mine = label[owner]
        order = np.lexsort((owner, mine, tokens))
        tokens, owner, mine = tokens[order], owner[order], mine[order]
        n = len(tokens)
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        lists = np.flatnonzero(new)
        runs = np.flatnonzero(new | np.concatenate([[True], mine[1:] != mine[:-1]]))
        end = np.repeat(np.append(lists[1:], n), np.diff(np.append(lists, n)))
        begin = np.repeat(np.append(runs[1:], n), np.diff(np.append(runs, n)))
        todo = end - begin
        total = np.cumsum(todo)
        pairs = _Pairs(len(sig))
        a = 0
        while a < n:
            base = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, base + chunk, side="right")))
            k = todo[a:b]
            left = np.repeat(np.arange(a, b), k)
            right = begin[left] + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
            i, j = owner[left], owner[right]
            ok = _fits(size, i, j, threshold)
            if ok.any():
                pairs.add(i[ok], j[ok])
            a = b
        return pairs.table(sig, need)

    return run


def _verify(threshold: float):
    """One block: the exact similarity of each candidate pair. Tokens of one document only can't be shared, so lists suffice."""

    def run(lists: pa.Table, pairs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"a": [], "b": [], "jaccard": []}
        rows = {r["sig"]: (r["n"], unpack(r["tokens"], r["k"], np.uint64)) for r in lists.to_pylist()}
        names = {s: i for i, s in enumerate(rows)}
        sizes = np.array([n for n, _ in rows.values()], np.int64)
        every = np.concatenate([t for _, t in rows.values()])
        _, ids = np.unique(every, return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum([len(t) for _, t in rows.values()])])
        a = np.array([names[s] for s in pairs["a"].to_pylist()], np.int64)
        b = np.array([names[s] for s in pairs["b"].to_pylist()], np.int64)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.diff(a, prepend=-1))
        mark = np.zeros(ids.max(initial=0) + 1, bool)
        sig = np.array(list(rows), np.int64)
        for i, j in zip(heads, [*heads[1:], len(a)], strict=True):
            mine = ids[bounds[a[i]] : bounds[a[i] + 1]]
            mark[mine] = True
            for other in b[i:j]:
                shared = int(mark[ids[bounds[other] : bounds[other + 1]]].sum())
                union = sizes[a[i]] + sizes[other] - shared
                if shared >= threshold * union - 1e-9:
                    for c, x in zip(out, (sig[a[i]], sig[other], shared / union), strict=True):
                        out[c].append(x)
            mark[mine] = False
        return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "jaccard": pa.array(out["jaccard"], pa.float64())})

    return run


def _count_links(threshold: float):
    """One block of a cluster: for each set, how many documents have another set of the similarity; exact, pair by pair in arrays."""

    def run(table: pa.Table) -> pa.Table:
        row, col, part, copies, size, k = (np.asarray(table[c]) for c in ("row", "col", "part", "copies", "n", "k"))
        every = np.concatenate([unpack(t, int(n), np.uint64) for t, n in zip(table["tokens"].to_pylist(), k, strict=True)])
        _, token = np.unique(every, return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(k)])
        left, right = np.flatnonzero(part == row), np.flatnonzero(part == col)
        place = np.full(len(k), -1)
        place[right] = np.arange(len(right))
        # Postings of the right side, by token.
        owner = np.repeat(place, k)
        at = np.flatnonzero(owner >= 0)
        at = at[np.argsort(token[at], kind="stable")]
        begin = np.searchsorted(token[at], np.arange(token.max(initial=-1) + 2))
        owner = owner[at]
        out = np.zeros(len(k), np.int64)
        same = row[0] == col[0]
        for i in left.tolist():
            mine = token[bounds[i] : bounds[i + 1]]
            lo, many = begin[mine], begin[mine + 1] - begin[mine]
            met = owner[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
            shared = np.bincount(met, minlength=len(right))
            near = shared >= threshold * (size[i] + size[right] - shared) - 1e-9
            if same:
                near[place[i]] = False
            out[i] += copies[right[near]].sum()
            if not same:
                out[right[near]] += copies[i]
        return pa.table({"sig": table["sig"].combine_chunks(), "links": out})

    return run


def near_pairs(df: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, edges): the classes of near duplicates, without all pairs of a class.

    members: (doc_key, doc_id, sig) of every document; equal sets have an equal sig, and documents that can have no
    partner a NULL one. sets: (sig, n, k, copies, tokens, df), one row a set, however many copies it has. edges: (a, b),
    pairs of sets of Jaccard similarity >= threshold; every such pair is connected by edges, which are about as many as
    the sets: a first round links sets of long posting lists to one of each list, a second one meets sets that the first
    has not linked to the same.

    Hashed: a token has 40 to 63 bits (token_bits), a set's signature 64.
    """
    spark = df.sparkSession
    ship(spark)
    source = df.select(F.col(text).alias("text"), F.col(doc).cast("long").alias("doc_id"), row_key(doc, text).alias("doc_key"))
    characters = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets, bits = bucket_ids(spark, characters, BUCKET_CHARACTERS), token_bits(characters)
    back = source.mapInArrow(_send(buckets, bits, HOT), _SENT).groupBy("bucket").applyInArrow(_frequencies, _SENT)
    lists = written(back.groupBy("batch").applyInArrow(_assemble(threshold), _LISTS), "lists")
    members = lists.select("doc_key", "doc_id", "sig")
    copies = members.where("sig IS NOT NULL").select("sig", "doc_key").distinct().groupBy("sig").agg(F.count("*").alias("copies"))
    sets = lists.where("tokens IS NOT NULL").groupBy("sig").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first(F.struct("tokens", "df")).alias("list"))
    sets = written(sets.join(copies, "sig").select("sig", "n", "k", "copies", "list.tokens", "list.df"), "sets")

    def candidates(rows: DataFrame, meet) -> DataFrame:
        posts = rows.select("sig", "label", "n", "k", "tokens", "df").mapInArrow(_post(buckets, threshold), _POSTS)
        met = posts.groupBy("bucket").applyInArrow(meet, _PAIRS).groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need"))
        return _verified(sets, met.where("met >= need").select("a", "b"), threshold)

    first = candidates(sets.withColumn("label", F.col("sig")), _meet_hubs(threshold, DENSE))
    # Sets that are near one and the same set are connected by those two edges.
    label = first.groupBy(F.col("b").alias("sig")).agg(F.min("a").alias("label"))
    label = label.unionByName(first.select(F.col("a").alias("sig"), F.col("a").alias("label"))).groupBy("sig").agg(F.min("label").alias("label"))
    labelled = sets.join(small(written(label, "labels")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    second = candidates(labelled, _meet(threshold))
    return members, sets, first.unionByName(second)


def _verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the candidate pairs that have the similarity, as a written table."""
    pairs = written(pairs, "candidates")
    # Pairs of one cluster meet in one block: named by the least neighbour, and split by size where clusters are large.
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    name = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("cluster"))
    placed = pairs.join(name, "a")
    width = placed.groupBy("cluster").agg(F.ceil(F.greatest(F.approx_count_distinct("a"), F.approx_count_distinct("b")) / BLOCK).cast("long").alias("width"))
    placed = placed.join(width, "cluster").select("a", "b", "cluster", F.pmod("a", "width").alias("row"), F.pmod("b", "width").alias("col"))
    key = ["cluster", "row", "col"]
    wanted = placed.select(*key, F.explode(F.array("a", "b")).alias("sig")).distinct()
    held = wanted.join(sets.select("sig", "n", "k", "tokens"), "sig")
    other = placed.select("a", "b", *[F.col(c).alias("at_" + c) for c in key])
    near = held.groupBy(*key).cogroup(other.groupBy(*["at_" + c for c in key])).applyInArrow(_verify(threshold), "a long, b long, jaccard double")
    return written(near.select("a", "b"), "near")


def jaccard_classes(df: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, links): one row for each document.

    Sets are of lower-cased word n-grams (GRAM words, ASCII punctuation left out) of whole texts. links counts the other
    documents whose set has a Jaccard similarity >= threshold with this one's: all of them, copies with an equal set
    included. class_id is the least doc_id of the documents that such links connect.

    A document without links is a class of its own: so are NULL and empty texts, and those of punctuation only, which have
    no tokens. Texts under GRAM words are one token. NULL ids come after all others: a class is NULL if all its ids are.
    Rows with equal id and text are one document. Empty table: empty result. Extra columns are not read.
    """
    with scratch(df.sparkSession):
        return written(_classes(df, threshold, text, doc), "links", stays=True)


def _classes(df: DataFrame, threshold: float, text: str, doc: str) -> DataFrame:
    members, sets, edges = near_pairs(df, threshold=threshold, text=text, doc=doc)
    label = written(components(edges), "classes")
    held = sets.select("sig", "n", "k", "copies", "tokens").join(label.withColumnRenamed("node", "sig"), "sig")
    width = held.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("k") / BLOCK_TOKENS)).cast("long").alias("width"))
    held = held.join(width, "label").withColumn("part", F.pmod("sig", "width"))
    # A set goes to the blocks of its part with each part.
    held = held.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)))
    held = held.select("label", F.least("part", "with").alias("row"), F.greatest("part", "with").alias("col"), "part", "sig", "n", "k", "copies", "tokens")
    counted = held.groupBy("label", "row", "col").applyInArrow(_count_links(threshold), "sig long, links long").groupBy("sig").agg(F.sum("links").alias("links"))
    once = members.dropDuplicates(["doc_key"])
    low = members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("low")).join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = low.groupBy("label").agg(F.min("low").alias("class_id"))
    named = low.join(least, "label").join(sets.select("sig", "copies"), "sig").join(counted, "sig", "left")
    named = named.select("sig", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    some = once.where("sig IS NOT NULL").join(named, "sig").select("doc_id", "class_id", "links")
    return some.unionByName(once.where("sig IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b), for nodes that have an edge.

    Large-star and small-star rounds, which need about log(longest path) of them; each is written to the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to u's least neighbour (or u).
        star = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(star, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: neighbours below u, and u itself, go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = written(lower.where("u <> v").distinct(), "edges")
        same = after.count() == now.count() and not after.exceptAll(now).limit(1).count()
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def drop_near_dups(df: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """df with one document of each group of near duplicates, the one of least id; df's columns.

    Groups are the classes of jaccard_classes, whose cases hold here too: documents without tokens
    are in no group and stay. Repeated rows of a document that stays all stay; NULL ids come last in a group. Extra
    columns pass through, whatever their names.
    """
    with scratch(df.sparkSession):
        members, _, edges = near_pairs(df, threshold=threshold, text=text, doc=doc)
        labels = components(edges).withColumnRenamed("node", "sig")
        grouped = members.where("sig IS NOT NULL").join(labels, "sig", "left").withColumn("g", F.coalesce("label", "sig"))
        first = grouped.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("doc_key"))).alias("r"), F.min("doc_key").alias("k0"), F.max("doc_key").alias("k1")).where("k0 <> k1")
        gone = written(grouped.join(first.select("g", F.col("r.doc_key").alias("lead")), "g").where("doc_key <> lead").select("doc_key"), "gone", stays=True)
    (key,) = fresh(df, "key")
    gone = gone.withColumnRenamed("doc_key", key)
    return df.withColumn(key, row_key(doc, text)).join(small(gone), key, "left_anti").select(*df.columns)


#: jaccard_classes() over documents in DuckDB, for its default threshold and n-gram length.
CLASSES_SQL = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\t\n\x0b\x0c\r\x1c-\x20]+'), lambda x: x <> '') AS ws
    FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS s
    FROM cut
), owned AS (
    SELECT s, min(doc_id) AS id, list(doc_id) AS ids FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (
    SELECT id, len(s) AS n, unnest(s) AS token FROM owned
), met AS (
    SELECT a.id AS id_a, b.id AS id_b, count(*) AS c, max(a.n) + max(b.n) - count(*) AS u
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.id < b.id AND 2 * a.n >= b.n AND 2 * b.n >= a.n GROUP BY a.id, b.id
), ends AS (
    SELECT id_a AS x, id_b AS y FROM met WHERE 2 * c >= u UNION ALL SELECT id_b, id_a FROM met WHERE 2 * c >= u
), reached AS (
    SELECT id AS x, id AS y FROM owned UNION SELECT r.x, e.y FROM reached r JOIN ends e ON r.y = e.x
), class AS (
    SELECT x, min(y) AS class_id FROM reached GROUP BY x
), degree AS (
    SELECT x, sum(len(ids)) AS d FROM ends JOIN owned ON id = y GROUP BY x
)
SELECT unnest(ids) AS doc_id, class_id, CAST(coalesce(d, 0) + len(ids) - 1 AS BIGINT) AS links
FROM owned JOIN class ON class.x = id LEFT JOIN degree ON degree.x = id
UNION ALL SELECT doc_id, doc_id, CAST(0 AS BIGINT) FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NULL OR len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\t\n\x0b\x0c\r\x1c-\x20]+'), lambda x: x <> '')) = 0"""
