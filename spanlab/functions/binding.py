"""Bind a column expression to a name inside another one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``, where the optimizer would repeat it in every lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
