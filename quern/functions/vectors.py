"""Distances between array columns, in double precision and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return inner_product(a, b) / (norm(a) * norm(b))


#: Distance by the name of its metric: lower is nearer.
DISTANCES = {
    "l2sq": squared_l2,
    "cosine": lambda a, b: F.lit(1.0) - cosine(a, b),
    "ip": lambda a, b: F.lit(1.0) - inner_product(a, b),
}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {sorted(DISTANCES)}, not {metric!r}")
    return DISTANCES[metric](a, b)
