"""Standard mesh codes of Japan's grid squares, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(x: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x))).cast("int")


def _parts(lat: Column, lon: Column) -> tuple[Column, Column, Column, Column]:
    """Primary latitude and longitude codes, secondary row and column."""
    a, b = F.floor(lat / (2 / 3)).cast("int"), (F.floor(lon) - 100).cast("int")
    return a, b, _digit((lat - a * (2 / 3)) / (1 / 12), 8), _digit((lon - 100 - b) / 0.125, 8)


def mesh_code(lat: Column, lon: Column, level: int = 2) -> Column:
    """Code of the primary (1), secondary (2) or quarter (3) mesh as text of 4, 6 or 8 digits.

    An error where a primary code has not two digits; NULL for NULL coordinates.
    """
    a, b, row, col = _parts(lat, lon)
    code = F.concat(F.lpad(a.cast("string"), 2, "0"), F.lpad(b.cast("string"), 2, "0"))
    if level >= 2:
        code = F.concat(code, row.cast("string"), col.cast("string"))
    if level >= 3:
        r = _digit((lat - a * (2 / 3) - row * (1 / 12)) / (1 / 120), 10)
        c = _digit((lon - 100 - b - col * 0.125) / 0.0125, 10)
        code = F.concat(code, r.cast("string"), c.cast("string"))
    ok = a.between(0, 99) & b.between(0, 99)
    return F.when(lat.isNull() | lon.isNull(), F.lit(None)).when(ok, code).otherwise(F.raise_error(F.lit("coordinates outside the mesh")).cast("string"))


def mesh_key(lat: Column, lon: Column) -> Column:
    """The secondary mesh as a long, without a range check."""
    a, b, row, col = _parts(lat, lon)
    return ((a.cast("bigint") * 100 + b) * 10 + row) * 10 + col


def mesh_bounds(code: Column) -> list[Column]:
    """south, west, north, east of a 4, 6 or 8 digit code."""
    n = F.length(code)
    d = lambda i, k=1: F.substring(code, i, k).cast("double")
    south = d(1, 2) * (2 / 3) + F.when(n >= 6, d(5) * (1 / 12)).otherwise(0.0) + F.when(n >= 8, d(7) * (1 / 120)).otherwise(0.0)
    west = d(3, 2) + 100 + F.when(n >= 6, d(6) * 0.125).otherwise(0.0) + F.when(n >= 8, d(8) * 0.0125).otherwise(0.0)
    high = F.when(n == 4, 2 / 3).when(n == 6, 1 / 12).otherwise(1 / 120)
    wide = F.when(n == 4, 1.0).when(n == 6, 0.125).otherwise(0.0125)
    return [south.alias("south"), west.alias("west"), (south + high).alias("north"), (west + wide).alias("east")]


def mesh_neighbours(code: Column, ring: int = 1) -> Column:
    """Array of the secondary codes within `ring` cells, without the cell itself; codes out of range are left out."""
    row = F.substring(code, 1, 2).cast("int") * 8 + F.substring(code, 5, 1).cast("int")
    col = F.substring(code, 3, 2).cast("int") * 8 + F.substring(code, 6, 1).cast("int")

    def one(dr: int, dc: int) -> Column:
        r, c = row + dr, col + dc
        text = F.concat(F.lpad(F.floor(r / 8).cast("string"), 2, "0"), F.lpad(F.floor(c / 8).cast("string"), 2, "0"), F.pmod(r, F.lit(8)).cast("string"), F.pmod(c, F.lit(8)).cast("string"))
        return F.when(r.between(0, 799) & c.between(0, 799), text)

    return F.array_compact(F.array(*[one(r, c) for r in range(-ring, ring + 1) for c in range(-ring, ring + 1) if r or c]))
