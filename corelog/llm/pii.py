"""Personal data by a linear-chain conditional random field over word shapes (operator 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corelog.llm.common import slices
from corelog.llm.pii_examples import LABELS, examples
from corelog.plans.ship import ship

#: Labels whose tokens are left as they are.
SHOWN = ("O", "KEY")
#: Tokens that a Python worker remembers at most. Bounds memory, not results.
CACHE_TOKENS = 300_000

_LEAD, _TRAIL = "\"'([{<*_`", "\"')]}>,.;:!?*_`"
_EDGE = "".join(dict.fromkeys(_LEAD + _TRAIL))
_KEYWORDS = frozenset("password passwd pwd token key secret api_key apikey phone email card ip".split())


def features(token: str) -> tuple[str, ...]:
    """A token's features; they depend on nothing but the token. Words of letters have few distinct ones."""
    core = token.strip(_EDGE)
    if core.isalpha():
        kind = "lower" if core.islower() else "upper" if core.isupper() else "title" if core.istitle() else "mixed"
        word = core.lower()
        size = "1" if len(core) == 1 else "2-15" if len(core) < 16 else "16+"
        out = ("kind=" + kind, "size=" + size)
        if kind == "upper" and size == "16+":
            out += ("head=" + core[:4],)
        return (*out, "word=" + word) if word in _KEYWORDS else out
    if not core:
        return ("mark", "mark=" + token[:2])
    shape = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in core)
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = shape.count("9")
    groups = re.findall("9+", shape)
    out = [
        "shape=" + short[:12],
        "coarse=" + re.sub(r"([9aA])[9aA]*", "w", short)[:9],
        "digits=" + ("0" if not digits else "1-3" if digits < 4 else "4" if digits == 4 else "5-8" if digits < 9 else "9-12" if digits < 13 else "13-16" if digits < 17 else "17+"),
        "size=" + ("1-3" if len(core) < 4 else "4-8" if len(core) < 9 else "9-15" if len(core) < 16 else "16-24" if len(core) < 25 else "25+"),
        "turns=" + str(min(6, len(re.findall("9[aA]|[aA]9", short)) // 2)),
        "kind=" + ("number" if digits == len(core) else "digits" if digits * 2 > len(core) else "some" if digits else "none"),
    ]
    out += ["has=" + c for c in "@=:/.-_+()%$" if c in token]
    if 1 < len(groups) < 6:
        out.append("groups=" + ",".join(str(min(len(g), 5)) for g in groups))
    if shape.replace("9", "").replace(".", "") == "" and core.count(".") == 3:
        out.append("quad")
    tail = re.split("[=:]", core)[-1]
    if len(tail) >= 10 and re.fullmatch("[0-9a-f]+", tail):
        out.append("hex")
    if len(core) >= 16 and re.fullmatch("[A-Z0-9]+", core):
        out += ["capitals", "head=" + core[:4]]
    before = re.match(r"([A-Za-z_]+)[=:]", core)
    if before:
        out.append("before=" + (before[1].lower() if before[1].lower() in _KEYWORDS else "other"))
    at = core.rpartition("@")[2]
    if "@" in core and "." in at:
        out.append("host")
    return tuple(out)


@dataclass(frozen=True)
class Crf:
    """names: feature -> row of emit (features, labels); step: (labels, labels), from row to column."""

    names: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def emission(self, token_features: tuple[str, ...]) -> np.ndarray:
        return self.emit[[self.names[f] for f in token_features if f in self.names]].sum(0)

    @property
    def sure(self) -> float:
        """Where a token's first label leads all others by more, it is that label in every best path.

        Changing one token of a path from another label to the first one gains the lead, and loses at most this much
        in the two steps beside it.
        """
        return float((self.step - self.step[:, :1]).max() + (self.step - self.step[:1]).max())


def train(rows: list[tuple[int, int, str, str]] | None = None, *, steps: int = 150, l2: float = 5e-5, l2_step: float = 3e-3, rate: float = 0.2) -> Crf:
    """Maximum conditional likelihood on (sentence, place, token, label) rows (default: the table of pii_examples), by Adam."""
    rows = sorted(examples() if rows is None else rows, key=lambda r: r[:2])
    sentences: dict[int, list[tuple[str, str]]] = {}
    for i, _, t, label in rows:
        sentences.setdefault(i, []).append((t, label))
    names: dict[str, int] = {}
    k = len(LABELS)
    n, width = len(sentences), max(map(len, sentences.values()), default=1)
    gold = np.zeros((n, width), np.int64)
    mask = np.zeros((n, width), bool)
    cell, feature = [], []
    for i, s in enumerate(sentences.values()):
        for p, (t, label) in enumerate(s):
            gold[i, p], mask[i, p] = LABELS.index(label), True
            for f in features(t):
                cell.append(i * width + p)
                feature.append(names.setdefault(f, len(names)))
    cell, feature = np.array(cell, np.int64), np.array(feature, np.int64)
    emit, step = np.zeros((len(names), k)), np.zeros((k, k))
    state = [np.zeros_like(emit), np.zeros_like(step), np.zeros_like(emit), np.zeros_like(step)]
    tokens = max(int(mask.sum()), 1)
    pair = mask[:, 1:]
    gold_emit, gold_step = np.zeros_like(emit), np.zeros_like(step)
    np.add.at(gold_emit, (feature, gold.reshape(-1)[cell]), 1)
    np.add.at(gold_step, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for it in range(1, steps + 1):
        score = np.zeros((n * width, k))
        np.add.at(score, cell, emit[feature])
        score = score.reshape(n, width, k)
        fore, back = score.copy(), np.zeros_like(score)
        for t in range(1, width):
            fore[:, t] = np.where(mask[:, t, None], score[:, t] + lse(fore[:, t - 1, :, None] + step, 1), fore[:, t - 1])
        for t in range(width - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], lse(step + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        total = lse(fore[:, -1], 1)
        node = np.exp(fore + back - total[:, None, None]) * mask[:, :, None]
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, feature, node.reshape(-1, k)[cell])
        edge = np.exp(fore[:, :-1, :, None] + step + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
        g_step = (edge * pair[:, :, None, None]).sum((0, 1))
        for x, g, m, v in ((emit, (g_emit - gold_emit) / tokens + l2 * emit, state[0], state[2]), (step, (g_step - gold_step) / tokens + l2_step * step, state[1], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    return Crf(names, emit, step)


def viterbi(emissions: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best label paths of a batch of equally long sequences (n, length, labels).

    first, last: (n, labels), what the step into the first and out of the last token adds. Ties go to the lesser label.
    """
    n, length, k = emissions.shape
    best = emissions[:, 0] + first
    come = np.zeros((n, length, k), np.int8)
    for t in range(1, length):
        through = best[:, :, None] + step
        come[:, t] = through.argmax(1)
        best = through.max(1) + emissions[:, t]
    path = np.zeros((n, length), np.int64)
    path[:, -1] = (best + last).argmax(1)
    rows = np.arange(n)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = come[rows, t, path[:, t]]
    return path


class Tagger:
    """Labels texts; remembers each token's class, that is its features' emissions."""

    def __init__(self, model: Crf):
        self.model = model
        self.classes: dict[tuple[str, ...], int] = {}
        self.scores = np.zeros((0, len(LABELS)))
        self.sure = np.zeros(0, bool)
        self.tokens: dict[str, int] = {}
        self.bound = model.sure + 1e-9

    def _learn(self, new: set[str]) -> None:
        classes, tokens = self.classes, self.tokens
        for t in new:
            f = features(t)
            if f not in classes:
                classes[f] = len(classes)
            tokens[t] = classes[f]
        if len(classes) > len(self.scores):
            more = list(classes)[len(self.scores) :]
            self.scores = np.concatenate([self.scores, [self.model.emission(f) for f in more]])
            self.sure = self.scores[:, 0] - self.scores[:, 1:].max(1) > self.bound

    def label(self, lists: list[list[str]]) -> list[list[tuple[int, int]]]:
        """For each token list, (place, label) of the tokens that aren't O, by the exact best path.

        Tokens that are O in every best path cut a text into stretches that can be decoded apart; stretches of equal
        length are one numpy batch.
        """
        new = set(chain.from_iterable(lists)) - self.tokens.keys()
        if new:
            self._learn(new)
        sizes = np.array([0, *map(len, lists)], np.int64)
        bounds = np.cumsum(sizes)
        kind = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(lists)), np.int64, bounds[-1])
        if len(self.tokens) > CACHE_TOKENS or len(self.classes) > CACHE_TOKENS:
            scores, sure = self.scores, self.sure
            self.tokens.clear()
            if len(self.classes) > CACHE_TOKENS:
                self.classes.clear()
                self.scores, self.sure = scores[:0], sure[:0]
        else:
            scores, sure = self.scores, self.sure
        out: list[list[tuple[int, int]]] = [[] for _ in lists]
        open_ = np.flatnonzero(~sure[kind])
        if not len(open_):
            return out
        owner = np.searchsorted(bounds, open_, side="right") - 1
        head = np.ones(len(open_), bool)
        head[1:] = (open_[1:] != open_[:-1] + 1) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(head)
        length = np.diff(np.append(begin, len(open_)))
        start, text = open_[begin], owner[begin]
        zero = np.zeros(len(LABELS))
        for k in np.unique(length):
            rows = np.flatnonzero(length == k)
            e = scores[kind[start[rows][:, None] + np.arange(k)]]
            # Beside a stretch stand O's, or an end of the text.
            into = np.where((start[rows] > bounds[text[rows]])[:, None], self.model.step[0], zero)
            leave = np.where((start[rows] + k < bounds[text[rows] + 1])[:, None], self.model.step[:, 0], zero)
            path = viterbi(e, self.model.step, into, leave)
            for i, p in zip(*np.nonzero(path), strict=True):
                r = rows[i]
                out[text[r]].append((int(start[r] - bounds[text[r]] + p), int(path[i, p])))
        for x in out:
            x.sort()
        return out


_TOKEN = re.compile(r"\S+")


def spans(text: str, labels: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of what is to be hidden, in characters: tokens of one label side by side are one."""
    wanted = dict(labels)
    out: list[list] = []
    before = -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        label = LABELS[wanted.get(i, 0)]
        if label in SHOWN:
            continue
        word = m.group()
        lead = _LEAD.replace("(", "") if label == "PHONE" else _LEAD
        core = word.lstrip(lead).rstrip(_TRAIL.replace(")", "") if label == "PHONE" else _TRAIL) or word
        a = m.start() + word.index(core)
        b = a + len(core)
        if out and before == i - 1 and out[-1][2] == label and label in ("PHONE", "CARD"):
            out[-1][1] = b
        else:
            out.append([a, b, label])
        before = i
    return [tuple(x) for x in out]


def hide(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its label in brackets."""
    parts, at = [], 0
    for a, b, label in found:
        parts += [text[at:a], f"[{label}]"]
        at = b
    return "".join([*parts, text[at:]])


_KEPT: dict[int, Tagger] = {}


def redact(df: DataFrame, model: Crf, *, text: str = "text", count: str = "n_private", where: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all by default) with personal data in `text` replaced by [EMAIL], [IP], [PHONE], [CARD], [SECRET] or [ID].

    count: bigint, how many spans were replaced; where: if named, array<struct<start, stop, label>>, their characters in
    the given text. A text is one sequence of tokens between white space, labelled by the exact best path over all of it.
    One pass, no shuffle. Texts without a span stay byte for byte. NULL text: NULL, 0, no spans. Repeated rows are treated
    alike. Empty table: empty result. A clash of new names raises ValueError; other extra columns pass through.
    """
    keep = df.columns if keep is None else keep
    if text not in keep:
        keep = [*keep, text]
    new = [count, *([where] if where else [])]
    clash = {c.lower() for c in keep} & {c.lower() for c in new}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    ship(df.sparkSession)
    fields = [*[df.schema[c] for c in keep], T.StructField(count, T.LongType())]
    fields += [T.StructField(where, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("label", T.StringType())])))] if where else []
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if getattr(_KEPT.get(0), "model", None) is not shared.value:
            _KEPT[0] = Tagger(shared.value)
        tagger = _KEPT[0]
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                found: list[list] = [[] for _ in texts]
                for i, labels in enumerate(tagger.label([t.split() if t else [] for t in texts])):
                    if labels:
                        found[i] = spans(texts[i], labels)
                        texts[i] = hide(texts[i], found[i])
                changed = pa.array(texts, part.column(at).type)
                cols = [changed if c == text else part.column(part.schema.get_field_index(c)) for c in keep]
                cols.append(pa.array([len(x) for x in found], pa.int64()))
                if where:
                    cols.append(pa.array([[dict(zip(("start", "stop", "label"), s, strict=True)) for s in x] for x in found], span))
                yield pa.RecordBatch.from_arrays(cols, [*keep, *new])

    return df.select(*keep).mapInArrow(run, T.StructType(fields))
