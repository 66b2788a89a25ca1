"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: array functions evaluate an argument anew wherever it is written, inside a lambda for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
