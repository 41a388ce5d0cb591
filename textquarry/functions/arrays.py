"""Columns over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_of_array(values: Column | str) -> Column:
    return F.array_max(values)


def count_equal(values: Column | str, value) -> Column:
    """Elements equal to ``value``."""
    return F.size(F.filter(values, lambda x: x == value)).cast("long")
