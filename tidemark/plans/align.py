"""Queries over the alignment of speech and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import align as A
from tidemark.operators.numbering import row_chunks
from tidemark.operators.numbering import numbered
from tidemark.session import table

TAU = 2.0


def _frames(spark, folder):
    return A.usable_frames(table(spark, folder, "captions"))


def _segments(spark, folder):
    return A.usable_segments(table(spark, folder, "segments"))


def align_range_join(spark, folder):
    """Every (segment, frame) pair within the widened window."""
    spans = _segments(spark, folder).select(F.col("video_id").alias("k"), F.col("start_sec").alias("s"), F.col("end_sec").alias("e"), "segment_id")
    points = _frames(spark, folder).select(F.col("video_id").alias("k"), F.col("timestamp_sec").alias("t"), "caption_id")
    return A.range_pairs(spans, points, TAU).select("segment_id", "caption_id")


def visual_only_anchors(spark, folder):
    return A.visual_anchors(_frames(spark, folder), _segments(spark, folder), TAU)


def _said(o):
    """An observation as one text: model text, frame, hash and provenance."""
    p = o.model_provenance
    return F.concat_ws("~", o.raw_model_text, F.array_join(o.frame_ids, ","), F.array_join(o.frame_hashes, ","), *[F.coalesce(p[c], F.lit("")) for c in A.PROVENANCE])


def align_context_blocks(spark, folder):
    blocks = A.context_blocks(table(spark, folder, "segments"), table(spark, folder, "captions"), TAU)
    return blocks.select("video_id", "block_id", "start_sec", "end_sec", "speech", "caption", "frame_count", F.array_join("frame_ids", ",", "?").alias("frame_ids"), F.array_join(F.transform("observations", _said), "; ").alias("observations"), F.flatten(F.transform("observations", lambda o: o.source_pts_sec)).alias("observed_sec"), "visual_status", "source_type", "raw_transcript_segment_id")


def rate_limited_frames(spark, folder):
    return A.rate_limited(_frames(spark, folder), 5.0)


def chunk_windows(spark, folder):
    """Tumbling chunks of four frames in time order; a last one of at least two."""
    rows = numbered(_frames(spark, folder).select("video_id", "timestamp_sec", "caption_id"), "video_id", ["timestamp_sec", "caption_id"])
    chunks = row_chunks(rows, "video_id", "n", 4, ["timestamp_sec", "caption_id"])
    return chunks.select("video_id", "chunk", F.size("rows").alias("frames"), F.element_at("rows", 1)["timestamp_sec"].alias("start_sec"), F.element_at("rows", -1)["timestamp_sec"].alias("end_sec"))


def frames_per_second(spark, folder):
    """1 / mean step of each video's distinct frame times."""
    times = _frames(spark, folder).select("video_id", "timestamp_sec").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_sec").alias("a"), F.max("timestamp_sec").alias("b"))
    return times.where("n > 1").select("video_id", F.round((F.col("n") - 1) / (F.col("b") - F.col("a")), 6).alias("fps"))


def sampling_counts(spark, folder):
    """Frames by sampling folder."""
    return table(spark, folder, "captions").groupBy("video_id", F.substring_index("source_path", "/", 1).alias("sampling")).agg(F.count(F.lit(1)).alias("frames"))


def scene_or_fixed(spark, folder):
    """Scene frames of a video if it has any, else its fixed ones."""
    rows = table(spark, folder, "captions").select("video_id", "caption_id", F.coalesce(F.col("source_path").startswith("frames_scene/"), F.lit(False)).alias("scene"))
    has = rows.where("scene").select("video_id").distinct()
    return rows.where("scene").select("video_id", "caption_id").unionByName(rows.where("NOT scene").join(has, "video_id", "left_anti").select("video_id", "caption_id"))


QUERIES = {f.__name__: f for f in (align_range_join, visual_only_anchors, align_context_blocks, rate_limited_frames, chunk_windows, frames_per_second, sampling_counts, scene_or_fixed)}

_F = "f AS (SELECT * FROM captions WHERE isfinite(timestamp_sec) AND success IS DISTINCT FROM false), s AS (SELECT * FROM segments WHERE isfinite(start_sec) AND isfinite(end_sec) AND end_sec >= start_sec)"
_A = f"""WITH {_F},
u AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.video_id = f.video_id AND f.timestamp_sec >= s.start_sec - 2.0 AND f.timestamp_sec <= s.end_sec + 2.0)),
l AS (SELECT video_id, list(timestamp_sec ORDER BY caption_id) AS ts FROM u GROUP BY video_id),
k AS (SELECT video_id, list_reduce(ts, lambda acc, t: CASE WHEN len(list_filter(acc, lambda a: t >= a - 2.0 AND t <= a + 2.0)) > 0 THEN acc ELSE list_append(acc, t) END, []::DOUBLE[]) AS kept FROM (SELECT video_id, list_transform(ts, lambda t: [t]) AS tt, ts FROM l)),
a AS (SELECT video_id, t AS timestamp_sec, (SELECT min(caption_id) FROM u WHERE u.video_id = k2.video_id AND u.timestamp_sec = k2.t) AS caption_id FROM (SELECT video_id, unnest(kept) AS t FROM k) k2)"""

SQL = {
    "align_range_join": f"WITH {_F} SELECT segment_id, caption_id FROM s JOIN f USING (video_id) WHERE timestamp_sec >= start_sec - 2.0 AND timestamp_sec <= end_sec + 2.0",
    "visual_only_anchors": _A + " SELECT video_id, caption_id, timestamp_sec FROM a",
    "align_context_blocks": _A
    + """,
b AS (SELECT video_id, start_sec, end_sec, 0 AS kind, segment_id AS ord, trim(coalesce(text, '')) AS speech, coalesce(source_type, 'model_transcript') AS source_type, id AS raw_transcript_segment_id FROM s
      UNION ALL SELECT video_id, timestamp_sec, timestamp_sec, 1, caption_id, '', 'visual_only', NULL FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, end_sec, kind, ord) - 1 AS n FROM b),
j AS (SELECT n.video_id, n.n, list(struct_pack(c := caption, i := frame_id, m := (length(caption) > 0 AND length(frame_id) > 0 AND length(model) > 0 AND length(backend) > 0), t := coalesce(source_timestamp_sec, timestamp_sec), o := concat_ws('~', caption, frame_id, coalesce(frame_hash, ''), coalesce(model, ''), coalesce(backend, ''), coalesce(device, ''), coalesce(model_revision, ''), coalesce(run_id, ''), coalesce(prompt_sha256, ''))) ORDER BY caption_id) AS fr FROM n JOIN f ON f.video_id = n.video_id AND timestamp_sec >= start_sec - 2.0 AND timestamp_sec <= end_sec + 2.0 GROUP BY ALL)
SELECT n.video_id, format('ctx_{:04d}', n.n) AS block_id, start_sec, end_sec, speech,
  coalesce(array_to_string(list_reduce(list_filter(list_transform(fr, lambda x: x.c), lambda x: x IS NOT NULL AND x <> ''), lambda acc, x: CASE WHEN len(acc) >= 3 OR list_contains(acc, x) THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]), ' | '), '') AS caption,
  coalesce(len(fr), 0)::INTEGER AS frame_count, coalesce(array_to_string(list_transform(fr, lambda x: coalesce(x.i, '?')), ','), '') AS frame_ids, coalesce(array_to_string(list_transform(list_filter(fr, lambda x: x.m), lambda x: x.o), '; '), '') AS observations, coalesce(list_transform(list_filter(fr, lambda x: x.m), lambda x: x.t), []) AS observed_sec,
  CASE WHEN fr IS NULL THEN 'no_visual_observation' ELSE 'unvalidated_model_hypothesis' END AS visual_status, source_type, raw_transcript_segment_id
FROM n LEFT JOIN j ON j.video_id = n.video_id AND j.n = n.n""",
    "rate_limited_frames": f"WITH {_F}, l AS (SELECT video_id, list(timestamp_sec ORDER BY timestamp_sec, caption_id) AS ts FROM f GROUP BY video_id), k AS (SELECT video_id, list_reduce(ts, lambda acc, t: CASE WHEN len(acc) = 0 OR t - acc[-1] >= 5.0 THEN list_append(acc, t) ELSE acc END, []::DOUBLE[]) AS kept FROM l), e AS (SELECT video_id, unnest(kept) AS timestamp_sec FROM k) SELECT e.video_id, min(caption_id) AS caption_id, e.timestamp_sec FROM e JOIN f USING (video_id, timestamp_sec) GROUP BY ALL",
    "chunk_windows": f"WITH {_F}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, caption_id) - 1 AS n FROM f) SELECT video_id, n // 4 AS chunk, count(*)::INTEGER AS frames, min(timestamp_sec) AS start_sec, max(timestamp_sec) AS end_sec FROM n GROUP BY ALL HAVING count(*) >= 2",
    "frames_per_second": f"WITH {_F}, d AS (SELECT DISTINCT video_id, timestamp_sec FROM f), l AS (SELECT video_id, timestamp_sec - lag(timestamp_sec) OVER (PARTITION BY video_id ORDER BY timestamp_sec) AS d FROM d) SELECT video_id, round(1 / avg(d), 6) AS fps FROM l WHERE d IS NOT NULL GROUP BY video_id",
    "sampling_counts": "SELECT video_id, split_part(source_path, '/', 1) AS sampling, count(*) AS frames FROM captions GROUP BY ALL",
    "scene_or_fixed": "WITH r AS (SELECT video_id, caption_id, coalesce(starts_with(source_path, 'frames_scene/'), false) AS scene FROM captions) SELECT video_id, caption_id FROM r WHERE scene = (SELECT bool_or(scene) FROM r q WHERE q.video_id = r.video_id)",
}
