"""Order-dependent folds as array expressions. Callers keep the folded groups bounded (see operators.numbering.islands)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_apart(times: Column, tolerance: float) -> Column:
    """Of times in a given order, those with no earlier kept one within the closed tolerance."""
    empty = F.array().cast("array<double>")
    return F.aggregate(times, empty, lambda acc, t: F.when(F.exists(acc, lambda a: (t >= a - tolerance) & (t <= a + tolerance)), acc).otherwise(F.concat(acc, F.array(t))))


def keep_spaced(times: Column, step: float) -> Column:
    """Of ascending times the first, and then each that is at least `step` after the last kept one."""
    empty = F.array().cast("array<double>")
    return F.aggregate(times, empty, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= step), F.concat(acc, F.array(t))).otherwise(acc))
