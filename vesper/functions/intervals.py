"""Arithmetic of robustness intervals as pairs of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Interval = tuple[Column, Column]


def add(x: Interval, y: Interval) -> Interval:
    return x[0] + y[0], x[1] + y[1]


def subtract(x: Interval, y: Interval) -> Interval:
    return x[0] - y[1], x[1] - y[0]


def negate(x: Interval) -> Interval:
    return -x[1], -x[0]


def shift(x: Interval, by: float) -> Interval:
    return x[0] + F.lit(by), x[1] + F.lit(by)


def least(x: Interval, y: Interval) -> Interval:
    return F.least(x[0], y[0]), F.least(x[1], y[1])


def greatest(x: Interval, y: Interval) -> Interval:
    return F.greatest(x[0], y[0]), F.greatest(x[1], y[1])


def decided(x: Interval) -> Column:
    return x[0] == x[1]
