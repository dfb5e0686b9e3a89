"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(c: Column) -> Column:
    """Toward zero."""
    return c.cast("long")


def round_even(c: Column) -> Column:
    """Half to even."""
    return F.rint(c)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm(minus(a, b))


def clipped(c: Column) -> Column:
    """Into [-1, 1]; NULL stays NULL, which greatest and least would not grant."""
    return F.when(c > 1, F.lit(1.0)).when(c < -1, F.lit(-1.0)).otherwise(c)


def cosine(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """NULL for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def angle_over_pi(cos: Column) -> Column:
    return F.acos(clipped(cos)) / F.pi()


def xyz(prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}{suffix}") for c in "xyz"]


def frame_of(file_name: Column) -> Column:
    """Frame index in a file name such as img_C00_T00012.tif."""
    return F.regexp_extract(file_name, r"T(\d+)", 1).try_cast("int")
