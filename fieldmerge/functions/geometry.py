"""Distances and rounding of observation coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def manhattan(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.abs(ax - bx) + F.abs(ay - by)


def within(ax: Column, ay: Column, bx: Column, by: Column, tolerance: Column) -> Column:
    """Both coordinates differ by the tolerance at most, which counts as within."""
    return (F.abs(ax - bx) <= tolerance) & (F.abs(ay - by) <= tolerance)


def round2(value: Column) -> Column:
    """To 2 decimals, halves up, never negative zero."""
    return F.floor(value * 100 + 0.5) / F.lit(100.0)
