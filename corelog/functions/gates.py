"""Gates, target transforms and periodic features, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, threshold: float, softness: float) -> Column:
    """1 / (1 + exp(-u)), u = (x - threshold) / softness held in [-30, 30]."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (x - threshold) / softness))))


def bell(x: Column, centre: float, width: float) -> Column:
    return F.exp(-0.5 * F.pow((x - centre) / width, F.lit(2.0)))


def banded(x: Column, bands: list[tuple[float, float]]) -> Column:
    """Array of sigmoid gates (threshold, softness)."""
    return F.array(*[sigmoid(x, t, s) for t, s in bands])


def to_log(y: Column) -> Column:
    """log(1 + max(y, 0))."""
    return F.log1p(F.greatest(y, F.lit(0.0)))


def from_log(z: Column) -> Column:
    return F.expm1(z)


def log_moments(mu: Column, sd: Column, *, median: bool = False) -> tuple[Column, Column]:
    """Mean (or median) and deviation of y from those of log(1 + y)."""
    v = sd * sd
    mean = F.exp(mu + v / 2)
    return (F.expm1(mu) if median else mean - 1), mean * F.sqrt(F.expm1(v))


def fourier(x: Column, count: int, scale: int = 0) -> list[Column]:
    """sin and cos of x 2^(k + scale), k from 0."""
    return [f(x * math.ldexp(1.0, k + scale)) for k in range(count) for f in (F.sin, F.cos)]
