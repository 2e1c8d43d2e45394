"""Words of free text: maximal runs of Unicode letters and digits, lower-cased."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """The list of words; empty for null, empty and wordless texts."""
    return F.coalesce(F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower), F.array().cast("array<string>"))
