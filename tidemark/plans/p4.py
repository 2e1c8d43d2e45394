"""Queries of problem 4: covered periods and gaps of a video's memory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import periods_and_gaps, to_ms, valid_range
from tidemark.session import table

MAX_GAP_MS = 600_000


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memory_rows").where(valid_range(F.col("time_range"))).select("video_id", to_ms(F.col("time_range")[0]).alias("s"), to_ms(F.col("time_range")[1]).alias("e"))
    return periods_and_gaps(rows, "video_id", "s", "e", MAX_GAP_MS).select("video_id", "kind", F.col("start_at").alias("start_ms"), F.col("end_at").alias("end_ms"))


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
WITH r AS (SELECT video_id, CAST(round(time_range[1] * 1000) AS BIGINT) s, CAST(round(time_range[2] * 1000) AS BIGINT) e FROM memory_rows
           WHERE len(time_range) = 2 AND isfinite(time_range[1]) AND isfinite(time_range[2]) AND time_range[2] >= time_range[1]),
m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM r),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM m),
p AS (SELECT video_id, g, min(s) a, max(e) b FROM n GROUP BY ALL),
q AS (SELECT *, lead(a) OVER (PARTITION BY video_id ORDER BY g) nxt FROM p)
SELECT video_id, 'period' AS kind, a AS start_ms, b AS end_ms FROM q
UNION ALL SELECT video_id, 'gap', b, nxt FROM q WHERE nxt - b <= 600000
""",
}
