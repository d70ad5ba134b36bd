"""Language ID by error-correcting output codes (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corelog.llm.common import slices, utf8, written
from corelog.plans.ship import ship

#: Labelled texts that training draws at most, of each language, the least by a hash of text.
MAX_LABELLED = 400
#: Labelled texts in all: many languages share them evenly, so the driver's matrix is bounded.
MAX_ROWS = 16_000
#: Languages that training takes at most, those with most different texts.
MAX_LANGUAGES = 500
#: One of so many of a language's labelled texts is held out, to weigh the bits by how well their classifiers do on it.
HOLD_OUT = 5
#: Features are hashed byte n-grams of these lengths.
ORDERS = (2, 3)
BUCKETS = 1 << 13
#: A text is ambiguous if the losses of its two nearest codewords differ by less than this share of their sum.
MARGIN = 0.1

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """(n, bits) of -1 and 1, at least 2 n-way apart: all splits for up to 4 languages, else the best of seeded random codes."""
    if n <= 4:
        splits = [[1 if i == 0 or s >> (i - 1) & 1 else -1 for i in range(n)] for s in range(2 ** max(n - 1, 0) - 1)]
        return np.array(splits or [[1] * n], np.int8).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (m[:, None] != m[None]).sum(2)
        np.fill_diagonal(apart, bits)
        usable = bool((np.abs(m.sum(0)) < n).all())
        if usable and apart.min() > far:
            best, far = m, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    """languages; code: (languages, bits); weight: (BUCKETS, bits); bias: (bits,); trust: (languages, bits), each row of mean 1."""

    languages: tuple[str, ...]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def _nothing() -> Model:
    return Model((), np.zeros((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.zeros((0, 1)))


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): the hashed n-grams of each whole text, lower-cased; what isn't a letter counts as one space."""
    data, offsets = utf8(pc.utf8_lower(texts))
    data = np.where(_LETTER[data], data, np.uint8(32))
    n = len(texts)
    out, owners = [], []
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    for k in ORDERS:
        if len(data) < k:
            continue
        m = len(data) - k + 1
        key = np.zeros(m, np.uint32)
        blank = np.zeros(m, bool)
        for i in range(k):
            key = (key << np.uint32(8)) | data[i : i + m]
        for i in range(k - 1):
            blank |= (data[i : i + m] == 32) & (data[i + 1 : i + 1 + m] == 32)
        ok = (owner[:m] == owner[k - 1 : k - 1 + m]) & ~blank
        h = (key * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(7)
        out.append((h % np.uint32(BUCKETS)).astype(np.int32)[ok])
        owners.append(owner[:m][ok])
    if not out:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    buckets, owner = np.concatenate(out), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    return buckets[order], np.searchsorted(owner, np.arange(n + 1))


def train(df: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = MAX_LABELLED) -> Model:
    """A model from df's labelled rows; NULL languages and texts without letters don't take part.

    A bounded sample of per_language different texts each, copies counting once; whole texts are turned into n-gram shares
    by executors, numbers come back. Each bit is a logistic regression of the codewords' bit on the shares' square roots.
    One in HOLD_OUT texts of each language doesn't train: on those, the bits are weighed (see bit_trust).
    """
    ship(df.sparkSession)
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    ranked = rows.select("text", "lang", F.xxhash64("text", F.lit(5)).alias("h"))
    sizes = ranked.groupBy("lang").agg(F.count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = written(sizes, "languages")
    many = sizes.count()
    if not many:
        return _nothing()
    per_language = min(per_language, max(HOLD_OUT, MAX_ROWS // many))
    # A hash below this share leaves some 3 times as many as are wanted; where that is too few, all take part.
    cut = F.least(F.lit(1.0), F.lit(3.0 * per_language + 100) / F.col("n"))
    near = ranked.join(F.broadcast(sizes), "lang").where((F.col("h") / F.lit(2.0**64)) + 0.5 <= cut).select("text", "lang", "h").dropDuplicates(["lang", "h"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                buckets, bounds = gram_buckets(part.column(0))
                ids, values = [], []
                for i in range(len(part)):
                    k, c = np.unique(buckets[bounds[i] : bounds[i + 1]], return_counts=True)
                    ids.append(k)
                    values.append(np.sqrt(c / max(c.sum(), 1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "h", "ids", "values"])

    counted = near.mapInArrow(features, "lang string, h long, ids array<int>, values array<float>").where(F.size("ids") > 0)
    first = counted.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.hash("ids")))).where(F.col("nth") <= per_language)
    got: dict[str, list] = {}
    for r in first.select("lang", "ids", "values").orderBy("lang", "nth").collect():
        got.setdefault(r["lang"], []).append((r["ids"], r["values"]))
    names = sorted(got)
    if not names:
        return _nothing()
    x = np.zeros((sum(len(got[s]) for s in names), BUCKETS), np.float32)
    y = np.zeros(len(x), np.int64)
    rows = [(nth % HOLD_OUT == 0, k, row) for k, s in enumerate(names) for nth, row in enumerate(got[s], 1)]
    rows.sort(key=lambda r: r[0])  # what trains comes first
    for i, (_, k, (ids, values)) in enumerate(rows):
        x[i, ids] = values
        y[i] = k
    code, m = codewords(len(names)), sum(not r[0] for r in rows)
    weight, bias = fit_bits(x[:m], code[y[:m]].astype(np.float32))
    return Model(tuple(names), code, weight, bias, bit_trust(x[m:] @ weight + bias, y[m:], code))


def bit_trust(margins: np.ndarray, y: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(languages, bits): how far each bit's classifier is to be trusted on each language, rows scaled to a mean of 1.

    That is twice its accuracy on the language's held-out texts less 1, with one right and one wrong answer to everyone's
    account beforehand, and a hundredth at least; without held-out texts all bits of a language count alike.
    """
    trust = np.empty(code.shape)
    for k, word in enumerate(code):
        right = (np.sign(margins[y == k]) == word).sum(0)
        trust[k] = np.maximum(2 * (right + 1) / ((y == k).sum() + 2) - 1, 0.01)
    return trust / trust.mean(1, keepdims=True)


def fit_bits(x: np.ndarray, y: np.ndarray, *, steps: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of y's columns (-1, 1) on x, all at once, by accelerated gradient steps of 1 / curvature."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    v, c = w.copy(), b.copy()
    n = max(len(x), 1)
    rate = np.float32(4 * n / max(float((x * x).sum()) + n, 1e-9))
    for t in range(steps):
        p = -y / (1 + np.exp(np.clip(y * (x @ v + c), -30, 30))) / n
        nw, nb = v - rate * 4 * (x.T @ p + l2 * v), c - rate * p.sum(0)
        k = np.float32(t / (t + 3))
        v, c, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def decode(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword, relative lead over the next one) of rows of bit margins: the least sum of logistic losses of the bits,
    each weighted by the codeword's trust in that bit."""
    loss = np.stack([np.logaddexp(0, -margins * word) @ w for word, w in zip(code.astype(float), trust, strict=True)], 1)
    best = loss.argmin(1)
    if code.shape[0] < 2:
        return best, np.ones(len(loss))
    two = np.partition(loss, 1, 1)[:, :2]
    return best, (two[:, 1] - two[:, 0]) / np.maximum(two.sum(1), 1e-12)


def identify(
    df: DataFrame, model: Model, *, text: str = "text", language: str = "language", lead: str = "lead", ambiguous: str = "ambiguous", keep: list[str] | None = None
) -> DataFrame:
    """df's columns `keep` (all by default), the language of `text`, its relative lead and whether it is ambiguous. One pass, no shuffle.

    Each bit's margin is the classifier's over all n-grams of the whole text; the language is that of the codeword of
    least loss (ties: the first by name), and ambiguous means that the next one is within MARGIN of it. NULL texts and
    texts without letters, or a model without languages: language NULL, lead NULL, ambiguous true. Repeated rows are
    judged each. Empty table: empty result. A clash of names raises ValueError.
    """
    keep = df.columns if keep is None else keep
    new = [language, lead, ambiguous]
    clash = {c.lower() for c in keep} & {c.lower() for c in new}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    ship(df.sparkSession)
    source = df.select(*keep, *([] if text in keep else [text]))
    fields = [T.StructField(language, T.StringType()), T.StructField(lead, T.DoubleType()), T.StructField(ambiguous, T.BooleanType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                buckets, bounds = gram_buckets(part.column(at))
                empty = np.diff(bounds) == 0
                if m.languages:
                    margins = np.empty((len(part), m.code.shape[1]))
                    owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                    # Counts of each bucket of each text, then the square roots of their shares, as in training.
                    keys, counts = np.unique(owner * BUCKETS + buckets, return_counts=True)
                    rows = keys // BUCKETS
                    value = np.sqrt(counts / np.maximum(np.diff(bounds), 1)[rows])
                    weight = m.weight[keys % BUCKETS]
                    for k in range(margins.shape[1]):
                        margins[:, k] = np.bincount(rows, value * weight[:, k], len(part)) + m.bias[k]
                    best, far = decode(margins, m.code, m.trust)
                    names = pa.array(np.array(m.languages, object)[best], pa.string(), mask=empty)
                else:
                    far, names, empty = np.zeros(len(part)), pa.nulls(len(part), pa.string()), np.ones(len(part), bool)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, names, pa.array(far, mask=empty), pa.array(empty | (far < MARGIN))], [*keep, *new])

    return source.mapInArrow(run, T.StructType([*[df.schema[c] for c in keep], *fields]))
