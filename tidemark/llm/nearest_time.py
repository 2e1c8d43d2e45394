"""Matching records by nearest time (problem 5), by tick expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import finite, to_ms
from tidemark.session import table

#: A record longer than this many ticks is expanded to ticks FANOUT times as wide, and so on; so no record has more ticks than this, give or take two.
FANOUT = 64


def _tick(c: Column, width: int) -> Column:
    return F.floor(c / width).cast("long")


def _level_ticks(spans: DataFrame, tolerance: int, width: int) -> DataFrame:
    """Per (k, tick) the list of records that can be nearest to some instant of the tick, given spans of (k, s, e, id)."""
    ticks = spans.select("*", F.explode(F.sequence(_tick(F.col("s") - tolerance, width), _tick(F.col("e") + tolerance, width))).alias("tick"))
    first, last = F.col("tick") * width, F.col("tick") * width + (width - 1)
    # Of the records that end before the tick only the latest end can win, of those that start after it only the earliest start. Of
    # those that meet the tick and end at the same instant (all ends beyond the tick count as one) only the smallest start and id can.
    group = F.when(F.col("e") < first, -1).when(F.col("s") > last, -2).otherwise(F.least(F.col("e"), last) - first)
    best = ticks.groupBy("k", "tick", group.alias("g")).agg(F.min(F.struct(F.when(F.col("e") < first, -F.col("e")).otherwise(0).alias("o"), F.col("s"), F.col("id"), F.col("e"))).alias("b"))
    return best.groupBy("k", "tick").agg(F.collect_list(F.struct(F.col("b.s").alias("s"), F.col("b.id").alias("id"), F.col("b.e").alias("e"))).alias("c"))


def match_nearest(left: DataFrame, right: DataFrame, tolerance: int, tick: int | None = None) -> DataFrame:
    """Pair each left record (k, t, left_id) with the nearest right record (k, s, e, id) of the same k, at most `tolerance` away.

    Times are whole numbers (milliseconds). The distance is 0 inside the closed interval [s, e], else to its nearer end; an instant
    has s = e. Equal distances: smaller s, then smaller id. Output: left_id, id, distance; left records without a partner are left
    out. Rows with a null key or time, and right rows with e < s, match nothing. Repeated rows on either side count each; other
    columns are ignored. Empty tables give an empty result.

    Method: each right record is expanded to the discrete ticks it can serve; per entity and tick only records that can be nearest
    somewhere in the tick are kept (at most one per instant of the tick, plus two), and left records meet them by an equi-join on
    (k, tick). Equal intervals are collapsed first, both reductions combine on the map side, and each tick is one row on the right of
    the join, so a crowded entity or tick is only ever many rows on the left, which may be split. Records longer than FANOUT ticks use
    wider ticks. Ticks as fine as the time resolution would make the per-tick winner final, at thousands of rows per record; a tick of
    the tolerance's width with a short list is exact too.
    """
    width = tick or max(1, tolerance)
    spans = right.select("k", "s", "e", "id").where("k IS NOT NULL AND s <= e").groupBy("k", "s", "e").agg(F.min("id").alias("id"))
    ratio = (F.col("e") - F.col("s")) / F.lit(float(width * FANOUT))
    level = F.when(ratio < 1, 0).otherwise(F.floor(F.log(F.greatest(ratio, F.lit(1.0))) / F.log(F.lit(float(FANOUT)))) + 1).cast("int")
    spans = spans.withColumn("level", level)
    most = spans.agg(F.max("level")).first()[0] or 0  # one number; 0 unless some record is very long

    def options(c: Column) -> Column:
        t = F.col("t")
        return F.array_min(F.transform(c, lambda x: F.struct(F.when(t < x.s, x.s - t).when(t > x.e, t - x.e).otherwise(0).cast("long").alias("distance"), x.s.alias("s"), x.id.alias("id"))))

    rows = left.select("k", "t", "left_id").where("k IS NOT NULL AND t IS NOT NULL").withColumn("best", F.lit(None).cast("struct<distance:bigint,s:bigint,id:bigint>"))
    for i in range(most + 1):
        w = width * FANOUT**i
        near = _level_ticks(spans.where(F.col("level") == i), tolerance, w)
        joined = rows.withColumn("tick", _tick(F.col("t"), w)).join(near, ["k", "tick"], "left")
        # least() skips nulls: a level without candidates changes nothing
        rows = joined.select("k", "t", "left_id", F.least(F.col("best"), options(F.col("c"))).alias("best") if i else options(F.col("c")).alias("best"))
    return rows.where(F.col("best.distance") <= tolerance).select("left_id", F.col("best.id").alias("id"), F.col("best.distance").alias("distance"))


TOLERANCE_MS = 2000


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest segment of each frame, with its distance."""
    frames = table(spark, folder, "captions").where(finite(F.col("timestamp_sec")) & ~F.col("success").eqNullSafe(False))
    spoken = table(spark, folder, "segments").where(finite(F.col("start_sec")) & finite(F.col("end_sec")) & (F.col("end_sec") >= F.col("start_sec")))
    left = frames.select(F.col("video_id").alias("k"), to_ms(F.col("timestamp_sec")).alias("t"), F.col("caption_id").alias("left_id"))
    right = spoken.select(F.col("video_id").alias("k"), to_ms(F.col("start_sec")).alias("s"), to_ms(F.col("end_sec")).alias("e"), F.col("segment_id").alias("id"))
    return match_nearest(left, right, TOLERANCE_MS).select(F.col("left_id").alias("caption_id"), F.col("id").alias("segment_id"), F.col("distance").alias("distance_ms"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_matches(spark, folder).select("caption_id", "segment_id")


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches}

_NEAREST = """
WITH c AS (SELECT caption_id, video_id, CAST(round(timestamp_sec * 1000) AS BIGINT) t FROM captions WHERE isfinite(timestamp_sec) AND success IS DISTINCT FROM false),
s AS (SELECT segment_id, video_id, CAST(round(start_sec * 1000) AS BIGINT) a, CAST(round(end_sec * 1000) AS BIGINT) b FROM segments WHERE isfinite(start_sec) AND isfinite(end_sec) AND end_sec >= start_sec),
j AS (SELECT caption_id, segment_id, a, CASE WHEN t < a THEN a - t WHEN t > b THEN t - b ELSE 0 END AS distance_ms FROM c JOIN s USING (video_id) WHERE t BETWEEN a - 2000 AND b + 2000),
k AS (SELECT *, row_number() OVER (PARTITION BY caption_id ORDER BY distance_ms, a, segment_id) AS rn FROM j)
"""

SQL = {
    "p5_found": _NEAREST + "SELECT caption_id, segment_id FROM k WHERE rn = 1",
    "p5_matches": _NEAREST + "SELECT caption_id, segment_id, distance_ms FROM k WHERE rn = 1",
}
