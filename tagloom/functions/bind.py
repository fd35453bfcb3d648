"""Evaluate an expression once and use its value many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[[Column], Column], **values) -> Column:
    """``body`` applied to a struct of the given values.

    The optimizer may copy a projected expression into a lambda, where it would run again for every
    element. Values bound here are computed once per row.
    """
    fields = [(v if isinstance(v, Column) else F.col(v)).alias(k) for k, v in values.items()]
    return F.element_at(F.transform(F.array(F.struct(*fields)), body), 1)
