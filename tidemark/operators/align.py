"""Alignment of two timed streams: widened range joins, visual-only anchors, context blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import HYPOTHESIS, numbered_id, strip, within
from tidemark.operators.intervals import finite
from tidemark.operators.numbering import islands, numbered
from tidemark.operators.ordered import CHUNK, chunked
from tidemark.session import shuffle_partitions


def usable_frames(captions: DataFrame) -> DataFrame:
    """Frames with a finite time that are not explicitly failed (null success stays)."""
    return captions.where(finite(F.col("timestamp_sec")) & ~F.col("success").eqNullSafe(False))


def usable_segments(segments: DataFrame) -> DataFrame:
    return segments.where(finite(F.col("start_sec")) & finite(F.col("end_sec")) & (F.col("end_sec") >= F.col("start_sec")))


def range_pairs(spans: DataFrame, points: DataFrame, tolerance: float, width: float = 8.0) -> DataFrame:
    """Inner join of spans (k, s, e, ...) with points (k, t, ...) where s - tolerance <= t <= e + tolerance.

    A bare range condition would compare all pairs of a video. Each span is sent to the time buckets it touches and each point is in
    exactly one bucket, so a pair meets once, by an equi-join on (k, bucket). A long video is many buckets. Spans whose ends are not
    finite, or reversed, must be left out before; null keys match nothing.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    sent = spans.withColumn("__b", F.explode(F.sequence(bucket(F.col("s") - tolerance), bucket(F.col("e") + tolerance))))
    placed = points.withColumnRenamed("k", "__k").withColumn("__pb", bucket(F.col("t")))
    return sent.join(placed, (F.col("k") == F.col("__k")) & (F.col("__b") == F.col("__pb"))).where(within(F.col("t"), F.col("s"), F.col("e"), tolerance)).drop("__b", "__pb", "__k")


def visual_anchors(frames: DataFrame, segments: DataFrame, tolerance: float) -> DataFrame:
    """Frames (video_id, caption_id, timestamp_sec) that stand for themselves: in order of caption_id, those with no segment and no
    earlier anchor within the tolerance.

    Greedy in the order of ids, but only frames within the tolerance of each other matter to one another: a video is cut at larger
    steps in time and each stretch is folded alone, with one look-up per frame (kept anchors lie in cells of the tolerance's width).
    """
    points = frames.select(F.col("video_id").alias("k"), F.col("timestamp_sec").alias("t"), F.col("caption_id").alias("id"))
    spans = segments.select(F.col("video_id").alias("k"), F.col("start_sec").alias("s"), F.col("end_sec").alias("e"))
    covered = range_pairs(spans, points, tolerance).select("id").distinct()
    silent = points.join(covered, "id", "left_anti").groupBy("k", "t").agg(F.min("id").alias("id"))  # of equal times only the first can stay
    cut_up = islands(silent, "k", "t", "id", tolerance + 1e-6, inclusive=False)
    # whole stretches, many to a group
    part = F.pmod(F.xxhash64("k", "island"), F.lit(8 * shuffle_partitions(frames.sparkSession)))
    kept = cut_up.select("k", "t", "id", part.alias("part")).groupBy("part").applyInPandas(lambda pdf: _apart(pdf, tolerance), _point_type(frames))
    return kept.select(F.col("k").alias("video_id"), F.col("id").alias("caption_id"), F.col("t").alias("timestamp_sec"))


def _point_type(frames: DataFrame) -> str:
    kind = lambda c: frames.schema[c].dataType.simpleString()
    return f"k {kind('video_id')}, t double, id {kind('caption_id')}"


def _apart(pdf: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """In order of id the points of each key with no earlier kept one within the closed tolerance. A cell of the tolerance's width holds
    at most two kept points, so each point looks at three cells."""
    pdf = pdf.sort_values("id", kind="stable")
    cells: dict[tuple, list[float]] = {}
    stays = []
    for k, t in zip(pdf["k"].factorize(use_na_sentinel=False)[0].tolist(), pdf["t"].tolist()):
        c = math.floor(t / tolerance) if tolerance > 0 else t
        near = (a for i in ((c - 1, c, c + 1) if tolerance > 0 else (c,)) for a in cells.get((k, i), ()))
        free = not any(a - tolerance <= t <= a + tolerance for a in near)
        if free:
            cells.setdefault((k, c), []).append(t)
        stays.append(free)
    return pdf.loc[stays, ["k", "t", "id"]]


def rate_limited(frames: DataFrame, step: float) -> DataFrame:
    """Frames kept at a fixed rate: the first of a video, then each that is at least `step` seconds after the last kept one.

    However long a video is, its frames are range-partitioned by time. Each chunk first says, for every frame on which the limiter may
    enter it (those up to `step` after its start, and the next), on which time it would leave it; one small fold over the chunks, at
    most a frame's worth of entries each, settles where it does enter; then the chunks keep their frames independently.
    """
    points = frames.select(F.col("video_id").alias("k"), F.col("timestamp_sec").alias("t"), F.col("caption_id").alias("id"))
    first = points.groupBy("k", "t").agg(F.min("id").alias("id"))  # of equal times only the first can be kept
    by = ["k", "t", "id"]
    rows = chunked(first, by)
    summaries = rows.groupBy(CHUNK).applyInPandas(lambda pdf: _ways_through(pdf, step), f"{CHUNK} int, k {frames.schema['video_id'].dataType.simpleString()}, head boolean, enter double, leave double")
    # a chunk's ways are the frames within one step of its start: few, and chunks are as many as partitions
    entered = summaries.coalesce(1).groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: _entries(pdf, step), f"{CHUNK} int, last double")
    known = rows.join(F.broadcast(entered), CHUNK, "left")
    kept = known.groupBy(CHUNK).applyInPandas(lambda pdf: _spaced(pdf, step), _point_type(frames))
    return kept.select(F.col("k").alias("video_id"), F.col("id").alias("caption_id"), F.col("t").alias("timestamp_sec"))


def _by_key(pdf: pd.DataFrame):
    """(key, sorted times, rows) of each key of a chunk, in order; null keys come first."""
    pdf = pdf.sort_values(["k", "t"], kind="stable", na_position="first")
    code = pdf["k"].factorize(use_na_sentinel=False)[0]
    edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(pdf)]
    for a, b in zip(edges, edges[1:]):
        part = pdf.iloc[a:b]
        yield part["k"].iloc[0], part["t"].to_numpy(), part


def _jumps(t: np.ndarray, step: float) -> np.ndarray:
    """For each time the place of the first one at least `step` later (by the same subtraction as the rule)."""
    to = np.searchsorted(t, t + step)
    for shift in (-1, 1):  # sums and differences may round differently by a place
        there = np.clip(to - 1 if shift < 0 else to, 0, len(t) - 1)
        far = t[there] - t >= step
        to = np.where((to > 0) & far, to - 1, to) if shift < 0 else np.where((to < len(t)) & ~far, to + 1, to)
    return to


def _ways_through(pdf: pd.DataFrame, step: float) -> pd.DataFrame:
    """(chunk, k, head, enter, leave) for the first and last key of a chunk: on entering at `enter`, the last kept time is `leave`. head is
    set for the chunk's first key; of other keys only the first frame can be where the limiter starts."""
    out, chunk, groups = [], pdf[CHUNK].iloc[0], list(_by_key(pdf))
    for g, (k, t, _) in enumerate(groups):
        if 0 < g < len(groups) - 1:
            continue
        to = _jumps(t, step)
        end = np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if to[i] < len(t):
                end[i] = end[to[i]]
        for i in range(min(len(t), int(to[0]) + 1) if g == 0 else 1):
            out.append((chunk, k, g == 0, t[i], t[end[i]]))
    return pd.DataFrame(out, columns=[CHUNK, "k", "head", "enter", "leave"])


def _entries(pdf: pd.DataFrame, step: float) -> pd.DataFrame:
    """(chunk, last): the last kept time before a chunk of the key that the chunk begins with; chunks that begin a key have none."""
    out, before, last = [], object(), None
    for chunk, ways in pdf.sort_values([CHUNK, "enter"], kind="stable").groupby(CHUNK, sort=True):
        head, tail = ways[ways["head"]], ways[~ways["head"]]
        k = head["k"].iloc[0]
        same = k == before or (k is None and before is None)
        if same:
            out.append((chunk, last))
            late = head[head["enter"] - last >= step]
            last = late["leave"].iloc[0] if len(late) else last
        else:
            last = head["leave"].iloc[0]
        before = k
        if len(tail):
            before, last = tail["k"].iloc[0], tail["leave"].iloc[0]
    return pd.DataFrame(out, columns=[CHUNK, "last"])


def _spaced(pdf: pd.DataFrame, step: float) -> pd.DataFrame:
    out = []
    for g, (_, t, rows) in enumerate(_by_key(pdf)):
        last, to, keep = rows["last"].iloc[0], _jumps(t, step), []
        i = 0
        if g == 0 and not np.isnan(last):
            far = np.flatnonzero(t - last >= step)
            i = int(far[0]) if len(far) else len(t)
        while i < len(t):
            keep.append(i)
            i = int(to[i])
        out.append(rows.iloc[keep][["k", "t", "id"]])
    return pd.concat(out)


def merged_caption(captions: Column, most: int = 3) -> Column:
    """The first `most` distinct nonempty captions in order, joined."""
    return F.array_join(F.slice(F.array_distinct(F.filter(captions, lambda c: c.isNotNull() & (c != ""))), 1, most), " | ")


PROVENANCE = ("model", "backend", "device", "model_revision", "run_id", "prompt_sha256")


# What a block keeps of each of its frames.
FRAME_FIELDS = ("frame_id", "timestamp_sec", "source_timestamp_sec", "source_path", "source_type", "model", "backend", "device")


def context_blocks(segments: DataFrame, captions: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Context blocks of every video: speech segments and visual-only anchors with the frames around them.

    Output: video_id, block_id, start_sec, end_sec, speech, confidence, caption, frame_count, frame_ids, frames (FRAME_FIELDS of each), observations (as structs),
    visual_status, source_type, raw_transcript_segment_id, duration_sec. Blocks are numbered per video by (start, end), speech before
    anchors, then ordinal. Frames keep the order of their ids. A segment without frames has an empty caption and the status
    no_visual_observation. Invalid segments and frames (see usable_*) are left out.
    """
    frames, spoken = usable_frames(captions), usable_segments(segments)
    anchors = visual_anchors(frames, spoken, tolerance)
    speech = spoken.select("video_id", F.col("start_sec").alias("s"), F.col("end_sec").alias("e"), F.lit(0).alias("kind"), F.col("segment_id").alias("ord"), strip(F.coalesce("text", F.lit(""))).alias("speech"), (1 - F.coalesce("no_speech_prob", F.lit(0.0))).alias("confidence"), F.coalesce("source_type", F.lit("model_transcript")).alias("source_type"), F.col("id").alias("raw_transcript_segment_id"))
    visual = anchors.select("video_id", F.col("timestamp_sec").alias("s"), F.col("timestamp_sec").alias("e"), F.lit(1).alias("kind"), F.col("caption_id").alias("ord"), F.lit("").alias("speech"), F.lit(1.0).alias("confidence"), F.lit("visual_only").alias("source_type"), F.lit(None).cast("long").alias("raw_transcript_segment_id"))
    blocks = numbered(speech.unionByName(visual), "video_id", ["s", "e", "kind", "ord"], "n")
    spans = blocks.select(F.col("video_id").alias("k"), "s", "e", "n")
    seen = [c for c in PROVENANCE if c in frames.columns]
    also = [c for c in FRAME_FIELDS if c in frames.columns and c not in (*seen, "frame_id", "timestamp_sec", "source_timestamp_sec")]
    points = frames.select(F.col("video_id").alias("k"), F.col("timestamp_sec").alias("t"), "caption_id", "frame_id", "caption", "source_timestamp_sec", "frame_hash", *also, *seen)
    row = F.struct("caption_id", "frame_id", "t", "caption", "source_timestamp_sec", "frame_hash", *also, *seen)
    met = range_pairs(spans, points, tolerance).groupBy("k", "n").agg(F.array_sort(F.collect_list(row)).alias("frames"))
    full = blocks.join(met.withColumnRenamed("k", "video_id"), ["video_id", "n"], "left").withColumn("frames", F.coalesce("frames", F.array().cast(met.schema["frames"].dataType)))

    def observation(f: Column) -> Column:
        filled = lambda c: c.isNotNull() & (c != "")
        known = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in seen]), F.array(*[f[c] for c in seen])), lambda _, v: v.isNotNull())
        return F.struct(f.caption.alias("raw_model_text"), F.array(F.coalesce(f.source_timestamp_sec, f.t)).alias("source_pts_sec"), F.array(f.frame_id).alias("frame_ids"), F.when(filled(f.frame_hash), F.array(f.frame_hash)).otherwise(F.array().cast("array<string>")).alias("frame_hashes"), known.alias("model_provenance"))

    usable = F.filter("frames", lambda f: (F.length(f.caption) > 0) & (F.length(f.frame_id) > 0) & (F.length(f.model) > 0) & (F.length(f.backend) > 0))
    return full.select(
        "video_id",
        numbered_id("ctx", F.col("n")).alias("block_id"),
        F.col("s").alias("start_sec"),
        F.col("e").alias("end_sec"),
        "speech",
        "confidence",
        merged_caption(F.transform("frames", lambda f: f.caption)).alias("caption"),
        F.size("frames").alias("frame_count"),
        F.transform("frames", lambda f: f.frame_id).alias("frame_ids"),
        F.transform("frames", lambda f: F.struct(*[(f.t if c == "timestamp_sec" else f[c]).alias(c) for c in FRAME_FIELDS if c in (*also, *seen, "frame_id", "timestamp_sec", "source_timestamp_sec")])).alias("frames"),
        F.transform(usable, observation).alias("observations"),
        F.when(F.size("frames") > 0, HYPOTHESIS).otherwise("no_visual_observation").alias("visual_status"),
        "source_type",
        "raw_transcript_segment_id",
        (F.col("e") - F.col("s")).alias("duration_sec"),
    )
