"""Queries over the evidence policy, caption documents and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import policy as P
from tidemark.operators import provenance as V
from tidemark.operators.align import usable_frames, usable_segments
from tidemark.operators.numbering import numbered, row_chunks
from tidemark.operators.intervals import finite
from tidemark.plans import windows as W
from tidemark.plans.checks import _EV, _S, _evidence
from tidemark.plans.windows import _frames
from tidemark.session import table


def _observations(spark, folder):
    """Captions as raw observations: two frames each for even ids (the second a second later, earlier for every tenth id), one else."""
    c = table(spark, folder, "captions")
    i = F.col("caption_id")
    two = lambda a, b: F.when(i % 2 == 0, F.array(a, b)).otherwise(F.array(a))
    pts = two(F.col("timestamp_sec"), F.col("timestamp_sec") + F.when(i % 10 == 0, -1.0).otherwise(1.0))
    hashes = F.when(F.col("frame_hash").isNotNull(), two(F.col("frame_hash"), F.when(i % 4 == 0, F.col("frame_hash")).otherwise(F.reverse("frame_hash"))))
    provenance = F.create_map(F.lit("model"), F.col("model"), F.lit("backend"), F.col("backend"))
    return c.select("caption_id", "video_id", "source_type", pts.alias("source_pts_sec"), two(F.col("frame_id"), F.concat("frame_id", F.lit("b"))).alias("frame_ids"), hashes.alias("frame_hashes"), provenance.alias("model_provenance"), "caption")


def hypothesis_records(spark, folder):
    """Every observation in its normal form, or the rule that it breaks."""
    h = P.hypotheses(_observations(spark, folder))
    ok = F.col("error").isNull()
    return h.select("caption_id", "error", F.when(ok, F.col("raw_text")).alias("raw_model_text"), F.when(ok, F.col("ids")).alias("frame_ids"), F.when(ok, F.col("pts")).alias("source_pts_sec"), F.when(ok, F.size("hashes")).alias("hashes"))


def temporal_assessments(spark, folder):
    h = P.hypotheses(_observations(spark, folder)).where("error IS NULL")
    return h.select("caption_id", P.assessment(F.col("ids"), F.col("hashes")).alias("a")).select("caption_id", "a.*")


def policy_answers(spark, folder):
    """Every segment's range as a question, with the observations of its first second and the memory rows of its video that are well
    formed evidence or cite the segment."""
    q = usable_segments(table(spark, folder, "segments")).select(F.col("segment_id").alias("question_id"), "video_id", "id", F.trim("text").alias("question"), F.col("start_sec").alias("q0"), F.col("end_sec").alias("q1"))
    second = F.floor("q0").cast("long")
    first = F.get("source_pts_sec", 0)
    seen = _observations(spark, folder).withColumn("at", F.when(finite(first), F.floor(first).cast("long")))
    raw = q.select("question_id", "video_id", second.alias("at")).join(seen, ["video_id", "at"]).withColumn("ordinal", F.col("caption_id"))
    e = _evidence(spark, folder).join(table(spark, folder, "memory_rows").select("memory_id", F.col("raw_transcript_segment_id").alias("id")), "memory_id")
    offered = q.select("question_id", "video_id", "id").join(e, ["video_id", "id"]).withColumn("ordinal", F.col("memory_id"))
    a = P.answers(q, raw, offered)
    return a.select("question_id", "error", "status", "answer", F.transform("accepted_evidence", lambda x: x.evidence_id).alias("evidence_ids"), F.transform("raw_hypotheses", lambda x: x.raw_model_text).alias("hypotheses"), F.transform("temporal_assessments", lambda x: x.sequence_state).alias("states"), "confidence")


def calibration_policy(spark, folder):
    return P.calibration_policy(spark)


def caption_documents(spark, folder):
    d = P.caption_documents(table(spark, folder, "captions"))
    ok = F.col("error").isNull()
    return d.select("caption_id", "video_id", F.when(ok, F.col("text")).alias("text"), F.when(ok, F.col("frame_timestamp_sec")).alias("at_sec"), "retrieval_mode", "asr_status", "verification_status", "error")


def selection_records(spark, folder):
    """Selected windows of each mode as self-describing records."""
    rows = [V.select_windows(_frames(spark, folder), m, s).where("selected").select("k", "candidate_id", "mode", "verification_status", "selection_scope", "accepted_as_fact") for m, s in (("change", "manifest"), ("uniform", "manifest"), ("anchored_change", "fixed"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _four(spark, folder):
    rows = numbered(usable_frames(table(spark, folder, "captions")).select("video_id", "timestamp_sec", "caption_id", "frame_id", "frame_hash", "source_path"), "video_id", ["timestamp_sec", "caption_id"])
    return row_chunks(rows, "video_id", "n", 4, ["frame_id", "frame_hash", "source_path", "timestamp_sec"], least=1)


def decoded_frame_hashes(spark, folder):
    """Pixel hashes of each chunk of four frames (the path stands for the pixels); none where one frame has none."""
    one = lambda r: V.pixel_hash(F.lit("RGB"), F.lit("(64, 36)"), F.encode(r.source_path, "UTF-8"))
    return _four(spark, folder).select("video_id", "chunk", V.frame_hashes(F.transform("rows", one)).alias("hashes"))


def preflight_checks(spark, folder):
    """Chunks of four frames as registered inputs, and traces that depart from them in each way."""
    c = F.col("chunk")
    pick = lambda f: F.transform("rows", lambda r: r[f])
    hashes, times = F.transform("rows", lambda r: F.coalesce(r.frame_hash, r.frame_id, F.lit("?"))), pick("timestamp_sec")
    record = F.struct(F.when(c % 7 == 1, "changed").otherwise("same").alias("digest"), F.lit("same").alias("registered_digest"), hashes.alias("frame_hashes"), times.alias("source_pts_sec"), F.size("rows").alias("frame_count"))
    trace = F.struct(F.when(c % 7 == 2, F.reverse(hashes)).otherwise(hashes).alias("frame_hashes"), F.when(c % 7 == 3, F.transform(times, lambda t: t + 1)).otherwise(times).alias("source_pts_sec"), F.when(c % 7 == 4, 2305).otherwise(1440).alias("tokens"))
    return _four(spark, folder).select("video_id", "chunk", V.preflight_errors(record, trace).alias("error"))


def arm_differences(spark, folder):
    return V.arm_differences(table(spark, folder, "captions"), "video_id", ["model", "backend", "device", "model_revision"]).select("video_id", "arms", F.array_join("differences", ",").alias("differences"))


def ordered_lookup(spark, folder):
    """Each memory row's segment and the next two, in this order, with their first delivered texts."""
    m = table(spark, folder, "memory_rows").select("memory_id", F.when(F.col("raw_transcript_segment_id").isNotNull(), F.transform(F.array(*[F.lit(i) for i in (2, 0, 1)]), lambda i: F.concat("video_id", F.lit("/"), (F.col("raw_transcript_segment_id") + i).cast("string")))).alias("ids"))
    s = table(spark, folder, "segments").select(F.concat("video_id", F.lit("/"), F.col("id").cast("string")).alias("key"), "segment_id", "text")
    return V.ordered_lookup(m, "memory_id", "ids", s, "key", "segment_id", "text")


def reference_intervals(spark, folder):
    """Segments' ranges under the first name for odd ids, under the second for even ones."""
    x = F.array("start_sec", "end_sec")
    i = F.col("segment_id") % 2 == 1
    return table(spark, folder, "segments").select("segment_id", V.reference_interval(F.when(i, x), F.when(~i, x)).alias("interval"))


def path_containment(spark, folder):
    """Paths of frames, and forms of them that leave their folder."""
    p = F.coalesce("source_path", F.lit(""))
    forms = F.array(p, F.concat(F.lit("../"), p), F.concat(F.lit("/"), p), F.concat(F.lit("a/../../"), p), F.concat(F.lit("./a/../"), p), F.lit("a/.."))
    return table(spark, folder, "captions").select("caption_id", F.posexplode(forms).alias("form", "path")).select("caption_id", "form", V.contained_path(F.col("path")).alias("inside"))


def frame_times(spark, folder):
    """The n-th frame of a video by its id with its n-th time; rows without a time make the counts differ."""
    c = table(spark, folder, "captions").where("frame_id IS NOT NULL").select("video_id", "frame_id", "timestamp_sec", "caption_id")
    files = c.groupBy("video_id", "frame_id").agg(F.min("caption_id").alias("caption_id"))
    times = usable_frames(table(spark, folder, "captions")).where("frame_id IS NOT NULL").groupBy("video_id", "frame_id").agg(F.min("timestamp_sec").alias("timestamp_sec"))
    return V.pair_times(files, times.select("video_id", "timestamp_sec", "frame_id"), "video_id", "frame_id", ["timestamp_sec", "frame_id"])


def scene_frames(spark, folder):
    e = table(spark, folder, "events").select("event_id", (F.col("value") / 100).alias("score"))
    return V.scene_frames(e, "score").select("event_id")


def merged_frame_maps(spark, folder):
    """Each video's split and license as one map, over which the verified ones' status wins."""
    v = table(spark, folder, "videos")
    base = F.create_map(F.lit("split"), F.col("split"), F.lit("status"), F.lit("unknown"))
    m = V.merged_maps(base, F.when(F.col("verification_status") == "verified", F.create_map(F.lit("status"), F.lit("verified"), F.lit("license"), F.col("license_id"))))
    return v.select("video_id", m["split"].alias("split"), m["status"].alias("status"), m["license"].alias("license"))


QUERIES = {f.__name__: f for f in (hypothesis_records, temporal_assessments, policy_answers, calibration_policy, caption_documents, selection_records, decoded_frame_hashes, preflight_checks, arm_differences, ordered_lookup, reference_intervals, path_containment, frame_times, scene_frames, merged_frame_maps)}

_SOLID = r"regexp_matches({}, '[^\s\x{{a0}}]')"
_O = (
    r"""WITH o AS (SELECT caption_id, video_id, source_type, caption, model, backend, frame_id, frame_hash, CASE WHEN caption_id % 2 = 0 THEN [timestamp_sec, timestamp_sec + CASE WHEN caption_id % 10 = 0 THEN -1.0 ELSE 1.0 END] ELSE [timestamp_sec] END AS pts,
  CASE WHEN caption_id % 2 = 0 THEN [frame_id, frame_id || 'b'] ELSE [frame_id] END AS ids, CASE WHEN frame_hash IS NULL THEN [] WHEN caption_id % 2 = 0 THEN [frame_hash, CASE WHEN caption_id % 4 = 0 THEN frame_hash ELSE reverse(frame_hash) END] ELSE [frame_hash] END AS hs FROM captions),
h AS (SELECT *, trim(regexp_replace(caption, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS txt, CASE WHEN source_type IS DISTINCT FROM 'model' THEN 'not a model observation' WHEN NOT coalesce(isfinite(pts[1]), false) THEN 'times are not finite' WHEN len(pts) > 1 AND pts[2] < pts[1] THEN 'times are not in order'
  WHEN NOT coalesce(frame_id <> '', false) THEN 'frames do not match times' WHEN NOT coalesce(model <> '' AND backend <> '', false) THEN 'no model and backend' WHEN NOT coalesce("""
    + _SOLID.format("caption")
    + r""", false) THEN 'no model text' WHEN len(hs) > 0 AND hs[1] = '' THEN 'hashes do not match times' END AS error FROM o),
a AS (SELECT *, CASE WHEN len(ids) > 1 AND len(hs) = len(ids) AND hs[1] = hs[2] THEN 'repeated_static_frames' WHEN len(ids) <= 1 THEN 'single_frame' ELSE 'nonidentical_frames_unverified' END AS state FROM h)"""
)
_C4 = "n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, caption_id) - 1 AS n FROM captions WHERE isfinite(timestamp_sec) AND success IS DISTINCT FROM false)"

SQL = {
    "hypothesis_records": _O + " SELECT caption_id, error, CASE WHEN error IS NULL THEN txt END AS raw_model_text, CASE WHEN error IS NULL THEN ids END AS frame_ids, CASE WHEN error IS NULL THEN pts END AS source_pts_sec, CASE WHEN error IS NULL THEN len(hs)::INTEGER END AS hashes FROM h",
    "temporal_assessments": _O + " SELECT caption_id, state AS sequence_state, false AS can_support_temporal_change, CASE state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.REASONS.items()) + " END AS reason FROM a WHERE error IS NULL",
    "policy_answers": _O
    + ", "
    + _EV.removeprefix("WITH ")
    + f""", {_S}, q AS (SELECT segment_id AS question_id, video_id, id, trim(text, ' ') AS question, start_sec AS q0, end_sec AS q1 FROM s),
hq AS (SELECT question_id, list(txt ORDER BY caption_id) AS hypotheses, list(state ORDER BY caption_id) AS states, arg_min(error, caption_id) FILTER (error IS NOT NULL) AS h_error FROM q JOIN a ON a.video_id = q.video_id AND isfinite(pts[1]) AND floor(pts[1]) = floor(q0) GROUP BY question_id),
eq AS (SELECT question_id, list(block_id ORDER BY r.memory_id) FILTER (a <= q1 AND q0 <= b) AS ids, string_agg(regexp_replace(claim, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'), ' ' ORDER BY r.memory_id) FILTER (a <= q1 AND q0 <= b) AS answer, arg_min(nullif(split_part(errors, ',', 1), ''), r.memory_id) FILTER (errors <> '') AS e_error
  FROM q JOIN memory_rows r ON r.video_id = q.video_id AND r.raw_transcript_segment_id = q.id JOIN x ON x.memory_id = r.memory_id GROUP BY question_id),
z AS (SELECT q.*, hypotheses, states, ids, eq.answer, coalesce(CASE WHEN NOT coalesce({_SOLID.format("question")}, false) THEN 'question must be nonempty' END, h_error, e_error) AS error FROM q LEFT JOIN hq USING (question_id) LEFT JOIN eq USING (question_id))
SELECT question_id, error, CASE WHEN error IS NULL THEN CASE WHEN len(ids) > 0 THEN 'supported' ELSE 'abstain' END END AS status, CASE WHEN error IS NULL THEN CASE WHEN len(ids) > 0 THEN answer ELSE '{P.ABSTAIN}' END END AS answer,
  CASE WHEN error IS NULL THEN coalesce(ids, []) END AS evidence_ids, CASE WHEN error IS NULL THEN coalesce(hypotheses, []) END AS hypotheses, CASE WHEN error IS NULL THEN coalesce(states, []) END AS states, CASE WHEN error IS NULL THEN 'not_calibrated' END AS confidence FROM z""",
    "calibration_policy": "SELECT 'experimental_not_calibrated' AS status, ['model confidence', 'retrieval distance', 'nonidentical frames'] AS forbidden_acceptance_signals",
    "caption_documents": r"""WITH d AS (SELECT caption_id, video_id, coalesce(source_timestamp_sec, timestamp_sec) AS t, source_type, caption FROM captions),
e AS (SELECT *, CASE WHEN video_id IS NULL THEN 'no video' WHEN source_type IS DISTINCT FROM 'model' THEN 'not a model observation' WHEN NOT coalesce(isfinite(t), false) THEN 'time is not finite' WHEN NOT coalesce(regexp_matches(caption, '[^\s\x{a0}]'), false) THEN 'no caption' END AS error FROM d)
SELECT caption_id, video_id, CASE WHEN error IS NULL THEN regexp_replace(caption, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') END AS text, CASE WHEN error IS NULL THEN t END AS at_sec, 'caption_only' AS retrieval_mode, 'not_run' AS asr_status, 'unvalidated_model_hypothesis' AS verification_status, error FROM e""",
    "selection_records": W._F
    + W._U.format(anchors=3)
    + W._G
    + f""", ua AS (SELECT k, c, least(2, 3, c - 3) AS cnt FROM (SELECT DISTINCT k, c FROM m)), us2 AS (SELECT DISTINCT k, CASE WHEN cnt = 1 THEN 0 ELSE CAST(round_even(i * (c - 4) / (cnt - 1), 0) AS BIGINT) END AS start FROM (SELECT *, unnest(range(cnt)) AS i FROM ua)),
al AS (SELECT k, list(start ORDER BY start) AS l0 FROM us2 GROUP BY k), ga AS (SELECT gl.k, unnest(list_reduce(l, lambda acc, s: CASE WHEN list_contains(acc, s) OR len(acc) >= 3 OR {W._NEW} < 2 OR {W._USED} + {W._NEW} > 12 THEN acc ELSE list_append(acc, s) END, l0)) AS start FROM gl JOIN al USING (k)),
r AS (SELECT m.k, {W._CHG} AS candidate_id, 'change' AS mode FROM m JOIN g USING (k, start) UNION ALL SELECT m.k, {W._UNI}, 'uniform' FROM m JOIN us USING (k, start) UNION ALL SELECT m.k, {W._CHG}, 'anchored_change' FROM m JOIN ga USING (k, start))
SELECT *, CASE mode WHEN 'change' THEN '{V.SELECTIONS["change"][0]}' WHEN 'uniform' THEN '{V.SELECTIONS["uniform"][0]}' ELSE '{V.SELECTIONS["fixed"][0]}' END AS verification_status, CASE mode WHEN 'anchored_change' THEN '{V.SELECTIONS["fixed"][1]}' ELSE '{V.SELECTIONS["change"][1]}' END AS selection_scope, false AS accepted_as_fact FROM r""",
    "decoded_frame_hashes": f"WITH {_C4} SELECT video_id, n // 4 AS chunk, CASE WHEN count(*) = count(source_path) THEN list(sha256('RGB:(64, 36):' || source_path) ORDER BY n) ELSE [] END AS hashes FROM n GROUP BY ALL",
    "preflight_checks": f"""WITH {_C4}, g AS (SELECT video_id, n // 4 AS chunk, list(coalesce(frame_hash, frame_id, '?') ORDER BY n) AS h, count(*) AS c FROM n GROUP BY ALL)
SELECT video_id, chunk, CASE WHEN chunk % 7 = 1 THEN 'record changed after registration' WHEN chunk % 7 = 2 AND list_reverse(h) <> h THEN 'decoder hashes differ' WHEN chunk % 7 = 3 THEN 'source times differ' WHEN len(list_distinct(h)) <> c THEN 'a frame is used again' WHEN chunk % 7 = 4 THEN 'too many visual tokens' END AS error FROM g""",
    "arm_differences": "SELECT video_id, count(*) AS arms, concat_ws(',', " + ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 OR (count(DISTINCT {c}) = 1 AND count({c}) < count(*)) THEN '{c}' END" for c in ("model", "backend", "device", "model_revision")) + ") AS differences FROM captions GROUP BY video_id",
    "ordered_lookup": """WITH s AS (SELECT video_id, id, arg_min(coalesce(text, chr(0)), segment_id) AS text FROM segments GROUP BY ALL), m AS (SELECT memory_id, video_id, raw_transcript_segment_id AS r FROM memory_rows),
e AS (SELECT memory_id, pos, s.text FROM m, (VALUES (0, 2), (1, 0), (2, 1)) AS o(pos, i) LEFT JOIN s ON s.video_id = m.video_id AND s.id = m.r + i WHERE m.r IS NOT NULL)
SELECT m.memory_id, coalesce(list(nullif(e.text, chr(0)) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS "values" FROM m LEFT JOIN e USING (memory_id) GROUP BY ALL""",
    "reference_intervals": "SELECT segment_id, CASE WHEN coalesce(isfinite(start_sec) AND isfinite(end_sec) AND end_sec > start_sec, false) THEN [start_sec, end_sec] END AS interval FROM segments",
    "path_containment": "SELECT caption_id, CAST(f AS INTEGER) AS form, CASE f WHEN 0 THEN coalesce(source_path, '') <> '' WHEN 4 THEN coalesce(source_path, '') <> '' ELSE false END AS inside FROM captions, range(6) r(f)",
    "frame_times": """WITH f AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY encode(frame_id)) - 1 AS n FROM (SELECT DISTINCT video_id, frame_id FROM captions WHERE frame_id IS NOT NULL)),
t AS (SELECT video_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t, encode(frame_id)) - 1 AS n FROM (SELECT video_id, frame_id, min(timestamp_sec) AS t FROM captions WHERE frame_id IS NOT NULL AND isfinite(timestamp_sec) AND success IS DISTINCT FROM false GROUP BY ALL)),
c AS (SELECT video_id, (SELECT count(*) FROM f WHERE f.video_id = v.video_id) <> (SELECT count(*) FROM t WHERE t.video_id = v.video_id) AS bad FROM (SELECT DISTINCT video_id FROM captions) v)
SELECT video_id, n, f.frame_id AS file, t.t, CASE WHEN bad THEN 'frame and time counts differ' END AS error FROM f FULL JOIN t USING (video_id, n) JOIN c USING (video_id)""",
    "scene_frames": "SELECT event_id FROM events WHERE value / 100 > 0.2",
    "merged_frame_maps": "SELECT video_id, split, CASE WHEN verification_status = 'verified' THEN 'verified' ELSE 'unknown' END AS status, CASE WHEN verification_status = 'verified' THEN license_id END AS license FROM videos",
}
