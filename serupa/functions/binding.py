"""Local names inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used several times is repeated in the plan, once more wherever a filter on it is pushed
    down, and inside a lambda it would even run per element. A lambda variable holds the result.
    """
    return F.transform(F.array(value), body)[0]
