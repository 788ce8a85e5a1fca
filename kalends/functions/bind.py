"""Binding an expression's value, which SQL expressions can't do by themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being evaluated once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
