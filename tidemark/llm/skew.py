"""Lookups that a hot key cannot stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when more than one in HOT_SHARE of all rows have it, so there are fewer than HOT_SHARE hot keys: that is what bounds the broadcast.
HOT_SHARE = 256


def lookup(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, row_id: str) -> DataFrame:
    """Inner join of `rows` with `keyed` (one row per key; `weight` is the number of rows with that key, `total` their sum).

    The values of hot keys travel by a broadcast of fewer than HOT_SHARE rows; the others meet by a shuffled join, in which rows that
    already have their values are spread by `row_id`. Null keys match nothing.
    """
    values = [c for c in keyed.columns if c not in (key, weight)]
    packed = keyed.select(F.col(key).alias("__k"), F.col(weight).alias("__w"), F.struct(*values).alias("__v"))
    hot = packed.where(F.col("__w") * HOT_SHARE > total).select(F.col("__k").alias("__hk"), F.col("__v").alias("__hv"))
    cold = packed.where(F.col("__w") * HOT_SHARE <= total).select(F.col("__k").alias("__ck"), F.col("__v").alias("__cv"), F.lit(0).cast("long").alias("__cs"))
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    salted = first.withColumn("__s", F.when(F.col("__hk").isNull(), F.lit(0).cast("long")).otherwise(F.col(row_id) + 1))
    both = salted.join(cold, (F.col(key) == F.col("__ck")) & (F.col("__s") == F.col("__cs")), "left")
    value = F.coalesce(F.col("__hv"), F.col("__cv"))
    return both.where(value.isNotNull()).select(*rows.columns, *[value[c].alias(c) for c in values])
