"""Ordered scans that do not depend on how rows spread over keys.

A window partitioned by an entity sends the whole entity to one task; when one video holds a third of all rows that task is the job.
Here the rows are range-partitioned by the full order (entity first, a unique id last), so that a large entity is cut into as many
chunks as it needs. Work inside a chunk is a window over the chunk; what crosses a chunk's border is carried by one summary row per
chunk, of which there are at most as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, shuffle_partitions

CHUNK = "__chunk"


def chunked(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition by `order` and number the chunks in that order (column __chunk). The result is checkpointed: the numbers must
    not change between its readers. Nulls sort first. An empty table stays empty."""
    n = partitions or shuffle_partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).withColumn(CHUNK, F.spark_partition_id()))


def _tiny_window() -> Window:
    # One row per chunk: bounded by the number of shuffle partitions.
    return Window.partitionBy(F.lit(0)).orderBy(CHUNK)


def chunk_offsets(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """For each chunk the sums of `totals` over all earlier chunks (0 for the first)."""
    sums = df.groupBy(CHUNK).agg(*[F.sum(c).alias(name) for name, c in totals.items()])
    before = _tiny_window().rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(CHUNK, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in totals])


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Adds for each (new name, column) the inclusive sum over all rows up to this one in the global order of a chunked table."""
    w = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    off = chunk_offsets(df, {f"__o_{n}": F.col(c) for n, c in sums.items()})
    inside = df.select("*", *[F.sum(c).over(w).alias(f"__i_{n}") for n, c in sums.items()])
    joined = inside.join(F.broadcast(off), CHUNK, "left")  # at most one row per shuffle partition
    return joined.select(*df.columns, *[(F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def previous_row(df: DataFrame, order: Sequence[str], fields: Sequence[str], name: str = "prev") -> DataFrame:
    """Adds struct `name` with `fields` of the preceding row in the global order of a chunked table; null for the very first row."""
    w = Window.partitionBy(CHUNK).orderBy(*order)
    here = F.struct(*fields)
    key = F.struct(*order)
    last = df.groupBy(CHUNK).agg(F.max(F.struct(key.alias("k"), here.alias("v"))).alias("last"))
    carried = last.select(CHUNK, F.lag("last.v").over(_tiny_window()).alias("__carried"))
    inside = df.select("*", F.lag(here).over(w).alias("__lag"), F.row_number().over(w).alias("__rn"))
    joined = inside.join(F.broadcast(carried), CHUNK, "left")
    return joined.select(*df.columns, F.when(F.col("__rn") == 1, F.col("__carried")).otherwise(F.col("__lag")).alias(name))
