"""Structured Streaming extensions: late and changed data by keyed replacement, and the rate limiter with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.memory import latest_deliveries
from tidemark.session import cut, scratch
from tidemark.sources.sinks import existing, overwrite_partitions, overwrite_videos


#: Partitions of a merged table: each holds the videos of one hash. A constant, as a video must be found again by a later batch.
BUCKETS = 128


def merge_rows(rows: DataFrame, path: str, keys: list[str], ordinal: str) -> None:
    """Merge rows into a table partitioned by video_bucket, a hash of video_id: of rows with the same video_id and `keys` that with the
    largest `ordinal` stays, whether it is new or was there. Only buckets of the videos in `rows` are read and written, so the files are
    bounded by the buckets and not by the videos; the same rows again change nothing. A table that is there by video_id stays so."""
    there = existing(rows.sparkSession, path)
    if there is not None and "video_bucket" not in there.columns:
        touched = rows.select(F.col("video_id").alias("__v")).distinct()
        old = there.withColumn("video_id", F.col("video_id").cast("string")).join(touched, F.col("video_id").eqNullSafe(F.col("__v")), "left_semi")
        return overwrite_videos(cut(latest_deliveries(old.unionByName(rows, allowMissingColumns=True), ["video_id", *keys], ordinal)), path)
    both = rows = rows.withColumn("video_bucket", F.pmod(F.xxhash64(F.col("video_id").cast("string")), F.lit(BUCKETS)).cast("int"))
    if there is not None:
        touched = [r[0] for r in rows.select("video_bucket").distinct().collect()]  # at most BUCKETS
        both = there.where(F.col("video_bucket").isin(touched)).unionByName(rows, allowMissingColumns=True)
    merged = latest_deliveries(both, ["video_id", *keys], ordinal)
    merged = cut(merged) if there is not None else merged  # its source is about to be written over
    # a bucket's rows meet before they are written, or every task would write a file to each; a large bucket is split again
    overwrite_partitions(merged.hint("rebalance", "video_bucket"), path, "video_bucket")


def replace_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, keys: list[str] | None = None, ordinal: str | None = None):
    """Keyed replacement over a stream. With `keys` and `ordinal` each micro-batch is merged row by row, so a video's rows may come in
    several batches. Without, a micro-batch must hold each of its videos whole: it replaces their rows. A batch that is run again gives
    the same table either way."""

    def write(df: DataFrame, _: int) -> None:
        with scratch(df.sparkSession):
            merge_rows(df, path, keys, ordinal) if keys is not None else overwrite_videos(df, path)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per key and window of event time, with a watermark for late ones."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("events"))


def rate_limited_stream(stream: DataFrame, step: float, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """The rate limiter over a stream (video_id, ts, t): within a batch in order of t, across batches by the last kept time.

    A row that comes after a later one was kept is left out. The state is one number per video and is dropped once the watermark has
    passed the video's last row by `idle_ms`; a video that starts again later starts afresh."""

    def limit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times, newest, kept = [], state.getCurrentWatermarkMs(), []
        for pdf in batches:
            times.append(pdf["t"].to_numpy(np.float64))
            newest = max(newest, int(pdf["at"].max().timestamp() * 1000))
        for t in np.sort(np.concatenate(times)):
            if last is None or t - last >= step:
                kept.append(float(t))
                last = float(t)
        state.update((last,))
        state.setTimeoutTimestamp(newest + idle_ms)
        yield pd.DataFrame({"video_id": [key[0]] * len(kept), "t": kept})

    # a stream's watermark begins at the epoch, where a row would count as late: a millisecond later it does not
    at = stream.select("video_id", (F.col("ts") + F.expr("INTERVAL 0.001 SECOND")).alias("at"), "t").withWatermark("at", late)
    return at.groupBy("video_id").applyInPandasWithState(limit, "video_id string, t double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
