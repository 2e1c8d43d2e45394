"""Repeated consecutive events (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.words import WORD, words
from tidemark.operators.intervals import to_ms, valid_range
from tidemark.operators.ordered import chunked, previous_row, running_sums
from tidemark.session import table


def at_most_one_edit(a: Column, b: Column) -> Column:
    """Whether two lists of words are equal or differ by one word replaced, added or dropped; null if either is null."""

    def dropped(long: Column, short: Column) -> Column:
        at = F.array_position(F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y)), True)  # the shorter list is padded with nulls
        return F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(long))

    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    by_size = F.size(a) - F.size(b)
    return F.when(a == b, True).when(by_size == 0, changed <= 1).when(by_size == 1, dropped(a, b)).when(by_size == -1, dropped(b, a)).otherwise(F.when(a.isNull() | b.isNull(), None).otherwise(False))


def collapse_runs(df: DataFrame, entity: str, order: Sequence[str], row_id: str, start: str, end: str, text: str) -> DataFrame:
    """Collapse runs of successive events of an entity whose texts have equal or nearly equal lists of words.

    Output: entity, first_id, last_id, events, start_at (of the first event), end_at (the latest end), one row per run, runs of one
    event included. `order` must end in a unique column; nulls sort first. Each event is compared with the one just before it. A null
    or wordless text has an empty list of words, which equals another empty one and any single word. An empty table gives an empty
    result; other columns are ignored.

    Method: lag, change flags, their running sum as the run's number, one aggregation. All four work on range-partitioned chunks of
    (entity, order), so a large entity is split over tasks; a long run is summed on the map side before it is shuffled.
    """
    keys = [f"o{i}" for i in range(len(order))]
    lean = df.select(F.col(entity).alias("k"), *[F.col(c).alias(o) for c, o in zip(order, keys)], F.col(row_id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(text).alias("text"))
    by = ["k", *keys]
    cut = chunked(lean, by).withColumn("w", words(F.col("text"))).drop("text")
    before = previous_row(cut, by, ["k", "w"])
    same = F.col("prev").isNotNull() & F.col("prev.k").eqNullSafe(F.col("k")) & at_most_one_edit(F.col("prev.w"), F.col("w"))
    flagged = before.select("__chunk", *by, "id", "s", "e", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1).alias("starts"))
    numbered = running_sums(flagged, by, {"run": "starts"})
    rank = F.struct(*keys)
    return (
        numbered.groupBy("k", "run")
        .agg(F.min(F.struct(rank.alias("o"), F.col("id"), F.col("s"))).alias("a"), F.max(F.struct(rank.alias("o"), F.col("id"))).alias("z"), F.count(F.lit(1)).alias("events"), F.max("e").alias("end_at"))
        .select(F.col("k").alias(entity), F.col("a.id").alias("first_id"), F.col("z.id").alias("last_id"), "events", F.col("a.s").alias("start_at"), "end_at")
    )


def without_copies(rows: DataFrame) -> DataFrame:
    """Memory rows of which no other has the same video_id and block_id and a smaller memory_id. Only the best row of a task's share
    is shuffled per key, so a key with very many copies stays small."""
    w = Window.partitionBy("video_id", "block_id").orderBy("memory_id")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memory_rows").select("memory_id", "video_id", "block_id", "time_range", "visual_caption")
    kept = without_copies(rows).where(valid_range(F.col("time_range")) & F.col("visual_caption").rlike(WORD))
    return kept.select("memory_id", "video_id", to_ms(F.col("time_range")[0]).alias("s"), to_ms(F.col("time_range")[1]).alias("e"), "visual_caption")


def p3_events(spark: SparkSession, folder: str) -> DataFrame:
    """One event for each run of the same caption, with its number of rows and its duration."""
    runs = collapse_runs(_events(spark, folder), "video_id", ["s", "e", "memory_id"], "memory_id", "s", "e", "visual_caption")
    return runs.select("video_id", "first_id", "last_id", "events", F.col("start_at").alias("start_ms"), (F.col("end_at") - F.col("start_at")).alias("duration_ms"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_events(spark, folder).where("events >= 2").select("video_id", "first_id", "last_id")


QUERIES = {"p3_found": p3_found, "p3_events": p3_events}

_RUNS = r"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY video_id, block_id ORDER BY memory_id) AS rn FROM memory_rows),
e AS (SELECT memory_id, video_id, CAST(round(time_range[1] * 1000) AS BIGINT) s, CAST(round(time_range[2] * 1000) AS BIGINT) e, list_transform(regexp_extract_all(visual_caption, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w
      FROM m WHERE rn = 1 AND len(time_range) = 2 AND isfinite(time_range[1]) AND isfinite(time_range[2]) AND time_range[2] >= time_range[1] AND regexp_matches(visual_caption, '[\p{L}\p{N}]')),
l AS (SELECT *, lag(w) OVER (PARTITION BY video_id ORDER BY s, e, memory_id) AS p FROM e),
f AS (SELECT *, CASE WHEN p IS NULL THEN 1 WHEN p = w THEN 0
        WHEN len(p) = len(w) AND len(list_filter(range(1, len(w) + 1), lambda i: p[i] <> w[i])) = 1 THEN 0
        WHEN len(p) = len(w) + 1 AND len(list_filter(range(1, len(p) + 1), lambda i: list_concat(p[:i - 1], p[i + 1:]) = w)) > 0 THEN 0
        WHEN len(w) = len(p) + 1 AND len(list_filter(range(1, len(w) + 1), lambda i: list_concat(w[:i - 1], w[i + 1:]) = p)) > 0 THEN 0 ELSE 1 END AS starts FROM l),
g AS (SELECT *, sum(starts) OVER (PARTITION BY video_id ORDER BY s, e, memory_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT video_id, run, arg_min(memory_id, (s, e, memory_id)) AS first_id, arg_max(memory_id, (s, e, memory_id)) AS last_id, count(*) AS events, min(s) AS start_ms, max(e) - min(s) AS duration_ms FROM g GROUP BY ALL)
"""

SQL = {
    "p3_found": _RUNS + "SELECT video_id, first_id, last_id FROM r WHERE events >= 2",
    "p3_events": _RUNS + "SELECT video_id, first_id, last_id, events, start_ms, duration_ms FROM r",
}
