"""XML files as rows: decoding by a ladder of encodings, a real parser in Arrow batches, layers, records, measurements."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelog.operators.joins import first_containing
from corelog.plans.ship import ship

ENCODINGS = tuple("utf-8 shift_jis cp932".split())
SEPARATOR = " || "
_DOCTYPE = re.compile(r"<!DOCTYPE(?:[^>\[]|\[[^\]]*\])*>\s*")


def decode_any(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The text by the first encoding that fits; the last one's error if none does."""
    for e in encodings[:-1]:
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            pass
    return content.decode(encodings[-1])


def parse(content: bytes) -> ElementTree.Element | None:
    """The root of a document without its DOCTYPE; None if it can't be decoded or parsed. A declared encoding is passed over,
    as the ladder has decided."""
    try:
        text = _DOCTYPE.sub("", decode_any(content), count=1)
        return ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text.lstrip("﻿")))
    except (ElementTree.ParseError, UnicodeDecodeError, ValueError):
        return None


def number(text: str | None) -> float | None:
    """A finite number, else None."""
    try:
        v = float((text or "").strip())
    except ValueError:
        return None
    return v if math.isfinite(v) else None


def _mapped(files: DataFrame, rows: Callable[[ElementTree.Element], list[tuple]], columns: dict[str, pa.DataType], *, empty: tuple | None = None) -> DataFrame:
    """(path, columns): rows(root) of every file of (path, content); a bad file gives the row `empty`, or none."""
    ship(files.sparkSession)
    names = list(columns)
    kinds = {pa.string(): "string", pa.float64(): "double", pa.int32(): "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, out = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(content.as_py()) if content.is_valid else None
                got = rows(root) if root is not None else [] if empty is None else [empty]
                paths += [path] * len(got)
                out += got
            parts = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array(p, t) for p, t in zip(parts, columns.values(), strict=True)]], ["path", *names])

    return files.select("path", "content").mapInArrow(run, ", ".join(["path string", *[f"{c} {kinds[t]}" for c, t in columns.items()]]))


def _tidy(e: ElementTree.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def elements(files: DataFrame, element: str, fields: dict[str, str]) -> DataFrame:
    """(path, place, fields): one row for each `element` anywhere in a file, in document order; a missing or empty field is NULL."""

    def rows(root: ElementTree.Element) -> list[tuple]:
        return [(i, *[_tidy(e.find(t)) or None for t in fields.values()]) for i, e in enumerate(root.iter(element))]

    return _mapped(files, rows, {"place": pa.int32(), **dict.fromkeys(fields, pa.string())})


def layers(files: DataFrame, element: str, text: str, top: str, bottom: str) -> DataFrame:
    """(path, place, top, bottom, text): layers with a text and rising finite bounds; others, and bad files, give no row."""

    def rows(root: ElementTree.Element) -> list[tuple]:
        out = []
        for i, e in enumerate(root.iter(element)):
            a, b, t = number(e.findtext(top)), number(e.findtext(bottom)), _tidy(e.find(text))
            if t and a is not None and b is not None and b > a:
                out.append((i, a, b, t))
        return out

    return _mapped(files, rows, {"place": pa.int32(), "top": pa.float64(), "bottom": pa.float64(), "text": pa.string()})


def records(files: DataFrame, element: str, text: str) -> DataFrame:
    """(path, n_layers, text): one row a file, its layers' texts joined by SEPARATOR; a bad file has 0 layers and ''."""

    def rows(root: ElementTree.Element) -> list[tuple]:
        found = [t for e in root.iter(element) if (t := _tidy(e.find(text)))]
        return [(len(found), SEPARATOR.join(found))]

    return _mapped(files, rows, {"n_layers": pa.int32(), "text": pa.string()}, empty=(0, ""))


def measurements(files: DataFrame, element: str, depth: str, families: list[list[str]], layer: DataFrame, *, most: float = 100) -> DataFrame:
    """(path, depth, n, text): measurements whose count is the sum of the first family of tags that isn't all 0, kept for
    0 < n <= most, with the text of the first layer (by place) that holds the depth; those in no layer are left out."""

    def rows(root: ElementTree.Element) -> list[tuple]:
        out = []
        for e in root.iter(element):
            z = number(e.findtext(depth))
            sums = [[int(number(e.findtext(t)) or 0) for t in tags] for tags in families]
            n = next((float(sum(s)) for s in sums if any(s)), 0.0)
            if z is not None and 0 < n <= most:
                out.append((z, n))
        return out

    found = _mapped(files, rows, {"depth": pa.float64(), "n": pa.float64()})
    return first_containing(found, layer.where("length(text) > 0"), ["path"], "depth", "top", "bottom", "place", ["text"])
