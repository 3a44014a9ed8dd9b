"""Names for values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it: expressions are trees, in which a used column is repeated."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
