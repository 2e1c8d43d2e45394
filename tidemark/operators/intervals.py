"""Overlapping and gapped intervals: a distributed sweep line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import chunked, running_sums


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def to_ms(c: Column) -> Column:
    """Seconds to whole milliseconds."""
    return F.round(c * 1000).cast("long")


def valid_range(c: Column) -> Column:
    """A two-element array with finite ends in order."""
    a, b = F.get(c, 0), F.get(c, 1)
    return F.coalesce((F.size(c) == 2) & finite(a) & finite(b) & (b >= a), F.lit(False))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Merge closed intervals of each `key` into maximal continuous periods and list the holes between them.

    Input: `start` and `end` as whole numbers with start <= end; other columns are ignored, whatever their names. Rows with a null
    start or end, or with end before start, are no intervals and are left out; a null key is an entity of its own. Touching intervals
    join; an interval without length is a period without length unless another covers it. Repeated rows change nothing. An empty
    table gives an empty result.

    Output: `key`, kind ('period' or 'gap'), start_at, end_at; a gap runs from the end of a period to the start of the next.

    Method: boundaries become +1/-1 events, summed per (key, instant) before any ordering, so the rows of one instant are one row;
    a prefix sum in the global order (key, instant) gives the number of open intervals. It may run across keys as each key's events
    sum to zero. Neither a large key nor a large instant meets in one task (see `ordered`).
    """
    spans = df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s <= e")
    events = spans.select("k", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("e").alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
    instants = events.groupBy("k", "x.t").agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down")).withColumn("d", F.col("up") - F.col("down"))
    order = ["k", "t"]
    swept = running_sums(chunked(instants, order), order, {"after": "d"})
    edges = swept.withColumn("opens", F.when(F.col("after") - F.col("d") == 0, 1).otherwise(0)).withColumn("closes", F.when(F.col("after") == 0, 1).otherwise(0)).where("opens = 1 OR closes = 1")
    numbered = running_sums(edges, order, {"n": "opens"})
    sides = F.flatten(
        F.array(
            F.when(F.col("opens") == 1, F.array(_side("period", F.col("n"), F.col("t"), None), _side("gap", F.col("n") - 1, None, F.col("t")))).otherwise(F.array().cast(_SIDES)),
            F.when(F.col("closes") == 1, F.array(_side("period", F.col("n"), None, F.col("t")), _side("gap", F.col("n"), F.col("t"), None))).otherwise(F.array().cast(_SIDES)),
        )
    )
    parts = numbered.select("k", F.explode(sides).alias("x")).select("k", "x.*")
    # A key's last period opens a gap that no start of the same key closes: it has no end and is dropped.
    whole = parts.groupBy("k", "kind", "n").agg(F.max("a").alias("start_at"), F.max("b").alias("end_at")).where("start_at IS NOT NULL AND end_at IS NOT NULL")
    return whole.select(F.col("k").alias(key), "kind", "start_at", "end_at")


_SIDES = "array<struct<kind:string,n:bigint,a:bigint,b:bigint>>"


def _side(kind: str, n: Column, a: Column | None, b: Column | None) -> Column:
    null = F.lit(None).cast("long")
    return F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), (null if a is None else a).alias("a"), (null if b is None else b).alias("b"))


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, max_gap: int | None = None) -> DataFrame:
    """`merge_intervals` without the gaps longer than `max_gap`."""
    out = merge_intervals(df, key, start, end)
    return out if max_gap is None else out.where((F.col("kind") == "period") | (F.col("end_at") - F.col("start_at") <= max_gap))
