"""Affine georeferencing: x = a col + b row + c, y = d col + e row + f."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Affine(NamedTuple):
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @property
    def determinant(self) -> float:
        return self.a * self.e - self.b * self.d

    @property
    def is_identity(self) -> bool:
        return tuple(self) == (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)

    def x(self, col: Column, row: Column) -> Column:
        return F.lit(self.a) * col + F.lit(self.b) * row + F.lit(self.c)

    def y(self, col: Column, row: Column) -> Column:
        return F.lit(self.d) * col + F.lit(self.e) * row + F.lit(self.f)


def as_affine(transform: object) -> Affine:
    """None is the identity; anything with attributes a to f, or a tuple of six numbers, is taken as it is."""
    if transform is None:
        return Affine()
    if all(hasattr(transform, k) for k in "abcdef"):
        return Affine(*(float(getattr(transform, k)) for k in "abcdef"))
    if isinstance(transform, tuple) and len(transform) == 6:
        return Affine(*map(float, transform))
    raise TypeError("transform must be a 6-tuple or an object with a, b, c, d, e, f attributes")
