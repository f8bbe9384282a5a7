"""Columns of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, the value worked out once a row, also where the optimizer writes expressions out in place of their names."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
