"""Arithmetic helpers matching the tracker's Python arithmetic.

Python ``round`` is half-even, so every rounding is ``bround``.  Division keeps
Python's operation order (``a / b * 100``, not ``a * 100 / b``) so that the
IEEE doubles, and therefore the ties, are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_round(c, scale: int = 0) -> Column:
    """Python ``round(x, scale)``; with scale 0 the result is BIGINT like Python's int."""
    r = F.bround(col(c).cast("double"), scale)
    return r.cast("bigint") if scale == 0 else r


def ratio_pct(num, den) -> Column:
    """``round(num / den * 100) if den else 0`` as BIGINT."""
    n, d = col(num), col(den)
    return F.when(d != 0, py_round(n.cast("double") / d * 100)).otherwise(F.lit(0).cast("bigint"))
