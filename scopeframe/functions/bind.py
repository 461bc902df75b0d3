"""A value that is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once a row, however often ``make`` or lambdas inside it name it."""
    return F.element_at(F.transform(F.array(value), make), 1)
