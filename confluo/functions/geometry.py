"""Rings of points by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def simplify_ring(ring: Column, digits: int = 2) -> Column:
    """Points rounded, equal neighbours dropped, the ring closed; null where fewer than four points are left."""
    points = F.transform(ring, lambda p: F.array(F.round(p[0], digits), F.round(p[1], digits)))
    thin = F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))
    closed = F.when(F.get(thin, F.lit(0)) == F.element_at(thin, -1), thin).otherwise(F.concat(thin, F.slice(thin, 1, 1)))
    return F.when(F.size(closed) >= 4, closed)


def box_area(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return (F.array_max(x) - F.array_min(x)) * (F.array_max(y) - F.array_min(y))


def main_rings(rings: Column, least: float = 0.008) -> Column:
    """Simplified rings of at least that area; if none is, the biggest, of equal ones the first."""
    thin = F.filter(F.transform(rings, lambda r: simplify_ring(r)), lambda r: r.isNotNull())
    large = F.filter(thin, lambda r: box_area(r) >= least)
    most = F.array_max(F.transform(thin, box_area))
    biggest = F.get(F.filter(thin, lambda r: box_area(r) == most), F.lit(0))
    return F.when(F.size(large) > 0, large).when(F.size(thin) > 0, F.array(biggest)).otherwise(large)


def polar_ring(n: int, radius: Column, start: float = 0.0) -> Column:
    """n seats on a circle: x, z and the angle that faces the middle."""
    angle = lambda i: F.lit(start) + i * 2 * F.pi() / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("section"), F.round(radius * F.cos(angle(i)), 6).alias("x"), F.round(radius * F.sin(angle(i)), 6).alias("z"), F.round(F.atan2(-F.sin(angle(i)), -F.cos(angle(i))), 6).alias("facing")))


def grid(rows: int, columns: int, width: float, depth: float) -> Column:
    """rows x columns sections around the middle."""
    cells = F.sequence(F.lit(0), F.lit(rows * columns - 1))
    return F.transform(cells, lambda i: F.struct(F.floor(i / columns).cast("int").alias("row"), (i % columns).alias("column"), F.round((i % columns - (columns - 1) / 2) * width, 6).alias("x"), F.round((F.floor(i / columns) - (rows - 1) / 2) * depth, 6).alias("z")))
