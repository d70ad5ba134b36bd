"""Published relations of ground engineering, as expressions over depth (m) and blow count N."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WATER = 9.81
ATMOSPHERE = 101.325


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def stresses(z: Column, table: Column, *, dry: float = 17.0, saturated: float = 19.0) -> tuple[Column, Column]:
    """Total and effective vertical stress (kPa); a NULL or NaN water table means a dry profile."""
    wet = table.isNotNull() & ~F.isnan(table) & (z > table)
    total = F.when(wet, dry * table + saturated * (z - table)).otherwise(dry * z)
    return total, F.when(wet, total - WATER * (z - table)).otherwise(total)


def reduction(z: Column) -> Column:
    """Liao and Whitman's two-piece stress reduction, held in [0.05, 1]."""
    return clamp(F.when(z < 9.15, 1 - 0.00765 * z).otherwise(1.174 - 0.0267 * z), 0.05, 1.0)


def stress_ratio(z: Column, table: Column, pga: float, **weights: float) -> Column:
    """Cyclic stress ratio of Seed and Idriss at a peak acceleration of `pga` g."""
    total, effective = stresses(z, table, **weights)
    return 0.65 * pga * (total / F.greatest(effective, F.lit(1e-3))) * reduction(z)


def corrected_n(n: Column, effective: Column, energy: float = 1.0) -> Column:
    """N1_60: overburden correction capped at 1.7."""
    return n * F.least(F.sqrt(ATMOSPHERE / F.greatest(effective, F.lit(1.0))), F.lit(1.7)) * energy


def resistance_ratio(n1: Column, *, fines: float = 5.0, magnitude: float = 7.5) -> Column:
    """Cyclic resistance ratio of Youd and Idriss, with fines and magnitude; 2.0 for dense soil."""
    fc = max(5.0, min(35.0, fines))
    shift = 1.5 * (fc - 5) / 10 if fc < 15 else 1.5 + 4 * (fc - 15) / 20
    cs = n1 + shift
    loose = F.least(cs, F.lit(29.99))
    base = 1 / (34 - loose) + loose / 135 + 50 / F.pow(10 * loose + 45, F.lit(2.0)) - 1 / 200
    scale = 10**2.24 / max(5.5, min(8.5, magnitude)) ** 2.56
    return F.when(cs < 30, base * scale).otherwise(2.0)


def shear_velocity(n: Column, relation: str = "imai_tonouchi") -> Column:
    """m/s from N, of at least 1, by Imai and Tonouchi 1982 or Wair and others 2012."""
    a, b = {"imai_tonouchi": (97.0, 0.314), "wair_holocene": (30.0, 0.215), "wair_pleistocene": (79.0, 0.434)}[relation]
    return a * F.pow(F.greatest(n, F.lit(1.0)), F.lit(b))


def risk_class(lpi: Column) -> Column:
    return F.when(lpi <= 0, "very_low").when(lpi <= 5, "low").when(lpi <= 15, "high").when(lpi.isNotNull(), "very_high")


def site_class(vs30: Column) -> Column:
    """NEHRP: A above 1500 m/s, down to E up to 180."""
    return F.when(vs30 > 1500, "A").when(vs30 > 760, "B").when(vs30 > 360, "C").when(vs30 > 180, "D").when(vs30 > 0, "E")


def allowable_bearing(n: Column, *, width: float = 1.0, embedment: float = 1.0, settlement: float = 25.0, wet: bool = False) -> Column:
    """Meyerhof's allowable pressure in kPa; NULL for N of 0 or less."""
    depth = min(1.33, 1 + 0.33 * embedment / width) * settlement / 25 * (0.5 if wet else 1.0)
    factor = 11.98 if width <= 1.22 else 7.99 * ((width + 0.305) / width) ** 2
    return F.when(n > 0, n * (factor * depth))


def bearing_class(q: Column) -> Column:
    return F.when(q < 100, "very_poor").when(q < 200, "poor").when(q < 400, "good").when(q.isNotNull(), "excellent")
