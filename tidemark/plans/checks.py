"""Queries over quality, contracts, model answers and the evidence policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import clock_seconds, https_url, sha256_hex
from tidemark.operators import contracts as C
from tidemark.operators import hypotheses as H
from tidemark.operators import memory as M
from tidemark.operators import quality as Q
from tidemark.operators.align import usable_frames, usable_segments
from tidemark.operators.intervals import valid_range
from tidemark.operators.numbering import numbered, row_chunks
from tidemark.session import table


def _rated(spark, folder):
    """Events as frames: value gives the sharpness, k of props the luma; k under 5 could not be read."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select(F.col("user_id").alias("video_id"), "event_id", F.when(k >= 5, F.col("value") * 8).alias("sharpness"), (k * 2.6).alias("luma"))


def quality_verdict(spark, folder):
    return _rated(spark, folder).select("event_id", Q.verdict(F.col("sharpness"), F.col("luma")).alias("verdict"))


def quality_stats(spark, folder):
    rows = _rated(spark, folder).withColumn("verdict", Q.verdict(F.col("sharpness"), F.col("luma")))
    return Q.verdict_counts(rows, "video_id").drop("duplicate")


def _cascade(spark, folder):
    """Captions as frames: measures made of their ids, and their hashes."""
    i = F.col("caption_id")
    rows = table(spark, folder, "captions").select("video_id", "caption_id", "frame_hash", F.when(i % 50 != 0, (i % 97 * 3).cast("double")).alias("sharpness"), (i % 53 * 5).cast("double").alias("luma"))
    return Q.with_duplicates(rows.withColumn("verdict", Q.verdict(F.col("sharpness"), F.col("luma"))), "video_id", "caption_id", "frame_hash")


def quality_cascade(spark, folder):
    """Every frame's last verdict, and what it is a duplicate of."""
    return _cascade(spark, folder).select("video_id", "caption_id", "verdict", "duplicate_of")


def quality_cascade_stats(spark, folder):
    return Q.verdict_counts(_cascade(spark, folder), "video_id")


def leader_dedup(spark, folder):
    return Q.leader_dedup(table(spark, folder, "captions"), "video_id", "caption_id", "frame_hash").select("video_id", "caption_id", "duplicate_of")


def exact_dup_hash(spark, folder):
    """Texts that occur more than once, by SHA-256."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return d.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def manifest_violations(spark, folder):
    return C.manifest_violations(table(spark, folder, "videos")).select("video_id", F.array_join("violations", ",").alias("violations"))


def url_contract(spark, folder):
    """Source addresses and forms of them that must not pass."""
    v = table(spark, folder, "videos").select("video_id", F.col("source_url").alias("u"))
    forms = F.array(F.col("u"), F.replace("u", F.lit("https://"), F.lit("http://")), F.replace("u", F.lit("https://"), F.lit("https://user:pw@")), F.lit("https:///nohost"))
    return v.select("video_id", F.posexplode(forms).alias("form", "url")).select("video_id", "form", https_url(F.col("url")).alias("ok"))


def checksum_contract(spark, folder):
    return table(spark, folder, "videos").select("video_id", sha256_hex(F.col("sha256")).alias("lower"), sha256_hex(F.upper("sha256")).alias("upper"))


def _clock(c):
    s = F.floor(c).cast("long")
    two = lambda x: F.format_string("%02d", x)
    return F.concat_ws(":", two(F.floor(s / 3600).cast("long")), two(F.floor(s % 3600 / 60).cast("long")), F.concat(two(s % 60), F.lit(".5")))


def _annotations(spark, folder):
    s = usable_segments(table(spark, folder, "segments"))
    start = F.when(F.col("segment_id") % 5 == 0, F.lit("0:00:01")).otherwise(_clock(F.col("start_sec")))
    return s.select("video_id", F.col("segment_id").cast("string").alias("annotation_id"), start.alias("start_text"), _clock(F.col("end_sec")).alias("stop_text"), F.trim(F.col("text")).alias("label"))


def timestamp_text_seconds(spark, folder):
    return _annotations(spark, folder).select("annotation_id", "start_text", clock_seconds(F.col("start_text")).alias("seconds"))


def reference_clip_rebase(spark, folder):
    videos = table(spark, folder, "videos").where(F.size("clip_interval_seconds") == 2)
    return C.clip_references(_annotations(spark, folder), videos)[0].select("video_id", "annotation_id", F.round("clip_start", 6).alias("clip_start"), F.round("clip_end", 6).alias("clip_end"))


def reference_rejects(spark, folder):
    videos = table(spark, folder, "videos").where(F.size("clip_interval_seconds") == 2)
    return C.clip_references(_annotations(spark, folder), videos)[1].select("video_id", "annotation_id", F.array_join("violations", ",").alias("violations"))


def label_firewall(spark, folder):
    return C.label_leaks(table(spark, folder, "eval_items"), table(spark, folder, "documents"))


def journal_state(spark, folder):
    e = table(spark, folder, "events")
    j = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("event"), F.floor(F.col("event_id") / 40 + F.col("user_id") % 2 * (F.col("event_id") % 3)).alias("generation"))
    return C.run_state(j)


def semantic_integrity(spark, folder):
    """Memory rows joined to the segments they cite, and those whose segment is missing."""
    rows = table(spark, folder, "memory_rows").select("memory_id", "video_id", F.col("raw_transcript_segment_id").alias("block_id"), "searchable_text")
    ctx = table(spark, folder, "segments").select("video_id", F.col("id").alias("block_id")).distinct()
    met, orphans = M.index_rows(rows, ctx)
    return met.select("memory_id", F.lit(True).alias("found")).unionByName(orphans.select("memory_id", F.lit(False).alias("found")))


def _evidence(spark, folder):
    """Memory rows as evidence records; reviewed ones have a method, and every row the flags it has."""
    method = F.when(F.col("source_type") == "visual_only", "independent_instrumented_measurement").otherwise("independent_human_review")
    t = F.col("time_range")
    return table(spark, folder, "memory_rows").select("memory_id", "video_id", F.col("block_id").alias("evidence_id"), F.col("summary").alias("claim"), F.get(t, 0).alias("start_sec"), F.get(t, 1).alias("end_sec"), F.when(F.col("source_type") == "visual_only", "instrumented_measurement").otherwise(F.when(F.col("source_type").isNotNull(), "human_review")).alias("source_type"), "verification_status", "accepted_as_fact", F.struct(method.alias("method"), F.col("video_id").alias("reviewer_or_system"), F.array("block_id").alias("source_evidence_ids")).alias("acceptance_provenance"))


def accepted_evidence_errors(spark, folder):
    return H.checked_evidence(_evidence(spark, folder)).select("memory_id", F.array_join("errors", ",").alias("errors"))


def answer_or_abstain(spark, folder):
    """Every segment's range as a question, answered by accepted rows of its video."""
    q = usable_segments(table(spark, folder, "segments")).select(F.col("segment_id").alias("question_id"), "video_id", F.col("start_sec").alias("q0"), F.col("end_sec").alias("q1"))
    ok = H.checked_evidence(_evidence(spark, folder)).where(F.size("errors") == 0).select("video_id", F.col("memory_id").alias("ordinal"), "start_sec", "end_sec", F.trim("claim").alias("claim"))
    return H.answer_ranges(q, ok)


def sequence_states(spark, folder):
    """The state of each chunk of four frames with hashes."""
    rows = numbered(usable_frames(table(spark, folder, "captions")).where("frame_hash IS NOT NULL").select("video_id", "timestamp_sec", "caption_id", "frame_id", "frame_hash"), "video_id", ["timestamp_sec", "caption_id"])
    chunks = row_chunks(rows, "video_id", "n", 4, ["frame_id", "frame_hash"], least=1)
    return chunks.select("video_id", "chunk", H.sequence_state(F.transform("rows", lambda r: r.frame_id), F.transform("rows", lambda r: r.frame_hash)).alias("state"))


def _answers(spark, folder):
    """A model answer for each memory row with a range, in eight forms: right ones, and each way to be wrong."""
    m = table(spark, folder, "memory_rows").where(valid_range(F.col("time_range")))
    t = F.col("time_range")[0]
    event = lambda body: F.concat(F.lit('{"events": [{"event_id": "e1", "verb": "lift", "object": "pan", "actor": "wearer", "direction": "up", "uncertain": false, '), body, F.lit("}]}"))
    forms = [event(F.lit('"evidence_frame_indices": [1, "3"]')), event(F.lit('"evidence_frame_indices": [1, 9]')), event(F.lit('"evidence_frame_indices": [true, 2]')), event(F.lit('"evidence_frame_indices": [2, 2]')), event(F.concat(F.lit('"evidence": [{"frame_id": "f1", "source_pts_sec": '), (t + 1).cast("string"), F.lit("}]"))), F.lit('{"events": []}'), F.lit('{"events": ["lift"]}'), F.lit('{"events": [')]
    text = F.element_at(F.array(*forms), (F.col("memory_id") % len(forms) + 1).cast("int"))
    return m.select(F.col("memory_id").alias("answer_id"), text.alias("raw_model_text"), F.array(*[F.lit(f"f{i}") for i in range(4)]).alias("frame_ids"), F.array(*[t + i for i in range(4)]).alias("source_pts_sec"), F.lit("source_chronological").alias("input_order"))


def event_dead_letter(spark, folder):
    return H.ingest_events(_answers(spark, folder)).select("answer_id", "position", "valid", F.array_join("errors", "; ").alias("errors"))


def hypothesis_outcomes(spark, folder):
    answers = _answers(spark, folder)
    reviews = answers.where("answer_id % 8 = 0").select("answer_id", F.lit("supported").alias("status"))
    return H.hypothesis_outcomes(answers, H.ingest_events(answers), reviews)


def json_contract(spark, folder):
    """Semantic answers made of each memory row, fenced for odd ids, with the intent as it stands."""
    none = F.array().cast("array<string>")
    body = F.to_json(F.struct(*[F.coalesce(F.col(c), none).alias(c) for c in ("topics", "decisions", "tasks")], none.alias("people"), none.alias("entities"), F.lower(F.trim("intent")).alias("intent"), F.col("summary"), F.col("model_confidence_unvalidated").alias("confidence")))
    text = F.when(F.col("memory_id") % 2 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, folder, "memory_rows").select("memory_id", H.parse_semantics(text).alias("p")).select("memory_id", F.col("p.error").alias("error"), F.col("p.intent").alias("intent"))


QUERIES = {f.__name__: f for f in (quality_verdict, quality_stats, quality_cascade, quality_cascade_stats, leader_dedup, exact_dup_hash, manifest_violations, url_contract, checksum_contract, timestamp_text_seconds, reference_clip_rebase, reference_rejects, label_firewall, journal_state, semantic_integrity, accepted_evidence_errors, answer_or_abstain, sequence_states, event_dead_letter, hypothesis_outcomes, json_contract)}

_V = "WITH r AS (SELECT user_id AS video_id, event_id, CASE WHEN (props->>'$.k')::DOUBLE >= 5 THEN value * 8 END AS s, (props->>'$.k')::DOUBLE * 2.6 AS l FROM events), q AS (SELECT *, CASE WHEN s IS NULL OR l IS NULL THEN 'unreadable' WHEN s < 60 THEN 'blurry' WHEN l < 40 THEN 'dark' WHEN l > 215 THEN 'bright' END AS verdict FROM r)"
_S = "s AS (SELECT * FROM segments WHERE isfinite(start_sec) AND isfinite(end_sec) AND end_sec >= start_sec)"
_CLK = "format('{{:02d}}:{{:02d}}:{{:02d}}.5', floor({0})::BIGINT // 3600, floor({0})::BIGINT % 3600 // 60, floor({0})::BIGINT % 60)"
_AN = f"""WITH {_S}, a AS (SELECT video_id, CAST(segment_id AS VARCHAR) AS annotation_id, CASE WHEN segment_id % 5 = 0 THEN '0:00:01' ELSE {_CLK.format('start_sec')} END AS start_text, CASE WHEN segment_id % 5 <> 0 THEN floor(start_sec) + 0.5 END AS st, floor(end_sec) + 0.5 AS e, trim(text, ' ') AS label FROM s)"""
_REF = _AN + """, j AS (SELECT a.*, clip_interval_seconds[1] AS c0, clip_interval_seconds[2] AS c1, concat_ws(',', CASE WHEN st IS NULL THEN 'clock text' END, CASE WHEN NOT coalesce(st >= 0 AND st < e AND e <= source_duration_seconds, false) THEN 'interval' END, CASE WHEN NOT coalesce(regexp_matches(label, '[^\\s\\x{a0}]'), false) THEN 'label' END) AS violations FROM a JOIN videos USING (video_id) WHERE len(clip_interval_seconds) = 2)"""
_EV = """WITH e AS (SELECT memory_id, video_id, summary AS claim, time_range[1] AS a, time_range[2] AS b, source_type, verification_status AS vs, accepted_as_fact AS f FROM memory_rows),
x AS (SELECT *, concat_ws(',', CASE WHEN vs IS DISTINCT FROM 'accepted_independent_evidence' THEN 'not independently accepted' END, CASE WHEN f IS DISTINCT FROM true THEN 'not accepted as fact' END, CASE WHEN NOT coalesce(isfinite(a) AND isfinite(b) AND a <= b, false) THEN 'bad interval' END, CASE WHEN NOT coalesce(regexp_matches(claim, '[^\\s\\x{a0}]'), false) THEN 'no claim' END, CASE WHEN source_type IS NULL THEN 'source does not match method' END) AS errors FROM e)"""
_HAM = "(0 + bit_count(xor(('0x' || substr(x, 1, 16))::UBIGINT, ('0x' || substr(h, 1, 16))::UBIGINT))::INTEGER + bit_count(xor(('0x' || substr(x, 17, 16))::UBIGINT, ('0x' || substr(h, 17, 16))::UBIGINT))::INTEGER + bit_count(xor(('0x' || substr(x, 33, 16))::UBIGINT, ('0x' || substr(h, 33, 16))::UBIGINT))::INTEGER + bit_count(xor(('0x' || substr(x, 49, 16))::UBIGINT, ('0x' || substr(h, 49, 16))::UBIGINT))::INTEGER)"

_LEAD = f"""l AS (SELECT video_id, list(hash ORDER BY caption_id) AS hs FROM c WHERE hash IS NOT NULL GROUP BY video_id),
k AS (SELECT video_id, list_reduce(hs, lambda acc, h: CASE WHEN len(list_filter(acc, lambda x: {_HAM} <= 6)) > 0 THEN acc ELSE list_append(acc, h) END, []::VARCHAR[]) AS kept FROM l),
d AS (SELECT c.video_id, c.caption_id, list_filter(kept, lambda x: {_HAM.replace('substr(h,', 'substr(c.hash,')} <= 6)[1] AS leader FROM c JOIN k USING (video_id) WHERE c.hash IS NOT NULL),
f AS (SELECT video_id, hash, min(caption_id) AS first_id FROM c WHERE hash IS NOT NULL GROUP BY ALL),
z AS (SELECT c.video_id, c.caption_id, CASE WHEN f.first_id <> c.caption_id THEN f.first_id END AS duplicate_of FROM c LEFT JOIN d USING (video_id, caption_id) LEFT JOIN f ON f.video_id = c.video_id AND f.hash = d.leader)"""
_CASC = f"""WITH r AS (SELECT *, CASE WHEN caption_id % 50 <> 0 THEN caption_id % 97 * 3 END AS s, caption_id % 53 * 5 AS b FROM captions), v AS (SELECT *, CASE WHEN s IS NULL THEN 'unreadable' WHEN s < 60 THEN 'blurry' WHEN b < 40 THEN 'dark' WHEN b > 215 THEN 'bright' END AS v0 FROM r),
c AS (SELECT video_id, caption_id, CASE WHEN regexp_full_match(frame_hash, '[0-9a-f]{{64}}') THEN frame_hash END AS hash FROM v WHERE v0 IS NULL), {_LEAD},
q AS (SELECT v.video_id, v.caption_id, coalesce(v0, CASE WHEN duplicate_of IS NULL THEN 'usable' ELSE 'duplicate' END) AS verdict, duplicate_of FROM v LEFT JOIN z USING (video_id, caption_id))"""

_DEAD = """WITH r AS (SELECT memory_id AS answer_id, memory_id % 8 AS form FROM memory_rows WHERE len(time_range) = 2 AND isfinite(time_range[1]) AND isfinite(time_range[2]) AND time_range[2] >= time_range[1]),
e AS (SELECT answer_id, CASE form WHEN 7 THEN 0 ELSE 1 END AS position, CASE form WHEN 1 THEN 'a frame position is outside the window' WHEN 2 THEN 'a frame position is no whole number' WHEN 3 THEN 'a frame position is given twice' WHEN 6 THEN 'event must be an object' WHEN 7 THEN 'invalid JSON' END AS error FROM r WHERE form <> 5)"""

SQL = {
    "quality_verdict": _V + " SELECT event_id, verdict FROM q",
    "quality_stats": _V + " SELECT video_id, count(*) AS candidates, count(*) FILTER (verdict IS NULL) AS usable, count(*) FILTER (verdict = 'unreadable') AS unreadable, count(*) FILTER (verdict = 'blurry') AS blurry, count(*) FILTER (verdict = 'dark') AS dark, count(*) FILTER (verdict = 'bright') AS bright FROM q GROUP BY video_id",
    "leader_dedup": f"WITH c AS (SELECT video_id, caption_id, CASE WHEN regexp_full_match(frame_hash, '[0-9a-f]{{64}}') THEN frame_hash END AS hash FROM captions), {_LEAD} SELECT video_id, caption_id, duplicate_of FROM z",
    "quality_cascade": _CASC + " SELECT video_id, caption_id, verdict, duplicate_of FROM q",
    "quality_cascade_stats": _CASC + " SELECT video_id, count(*) AS candidates, " + ", ".join(f"count(*) FILTER (verdict = '{x}') AS {x}" for x in ("usable", "unreadable", "blurry", "dark", "bright", "duplicate")) + " FROM q GROUP BY video_id",
    "exact_dup_hash": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "manifest_violations": r"""SELECT video_id, concat_ws(',', CASE WHEN NOT coalesce(regexp_full_match(video_id, '[A-Za-z0-9][A-Za-z0-9_.-]*') AND NOT contains(video_id, '..'), false) THEN 'video_id' END, CASE WHEN NOT coalesce(trim(split) <> '', false) THEN 'split' END, CASE WHEN NOT coalesce(trim(license_id) <> '', false) THEN 'license_id' END,
CASE WHEN NOT coalesce(regexp_full_match(source_url, 'https://[^/@?#]+([/?#].*)?'), false) THEN 'source_url' END, CASE WHEN timestamp_unit IS DISTINCT FROM 'seconds' THEN 'timestamp_unit' END, CASE WHEN timestamp_origin IS DISTINCT FROM 'source_video_start' THEN 'timestamp_origin' END, CASE WHEN NOT coalesce(isfinite(source_duration_seconds), false) THEN 'source_duration_seconds' END,
CASE WHEN NOT coalesce(len(clip_interval_seconds) = 2 AND isfinite(clip_interval_seconds[1]) AND isfinite(clip_interval_seconds[2]) AND clip_interval_seconds[1] >= 0 AND clip_interval_seconds[1] < clip_interval_seconds[2] AND clip_interval_seconds[2] <= source_duration_seconds, false) THEN 'clip_interval_seconds' END, CASE WHEN NOT coalesce(clip_interval_seconds[2] - clip_interval_seconds[1] <= 120, false) THEN 'clip_length' END,
CASE WHEN NOT coalesce(size_bytes IS NULL OR size_bytes BETWEEN 1 AND 268435456, false) THEN 'size_bytes' END, CASE WHEN NOT coalesce(verification_status IN ('pending', 'verified'), false) THEN 'verification_status' END, CASE WHEN NOT coalesce(CASE WHEN verification_status = 'verified' THEN coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) ELSE sha256 IS NULL OR regexp_full_match(sha256, '[0-9a-f]{64}') END, false) THEN 'sha256' END,
CASE WHEN NOT coalesce(verification_status <> 'verified' OR size_bytes IS NOT NULL, false) THEN 'verified_size' END) AS violations FROM videos""",
    "url_contract": "SELECT video_id, CAST(i AS INTEGER) AS form, CASE i WHEN 0 THEN coalesce(starts_with(source_url, 'https://'), false) ELSE false END AS ok FROM videos, (VALUES (0), (1), (2), (3)) v(i)",
    "checksum_contract": "SELECT video_id, coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) AS lower, coalesce(regexp_full_match(upper(sha256), '[0-9a-f]{64}'), false) AS upper FROM videos",
    "timestamp_text_seconds": _AN + " SELECT annotation_id, start_text, st AS seconds FROM a",
    "reference_clip_rebase": _REF + " SELECT video_id, annotation_id, round(greatest(st, c0) - c0, 6) AS clip_start, round(least(e, c1) - c0, 6) AS clip_end FROM j WHERE violations = '' AND st < c1 AND c0 < e",
    "reference_rejects": _REF + " SELECT video_id, annotation_id, violations FROM j WHERE violations <> ''",
    "label_firewall": r"""WITH i AS (SELECT list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT least(8, len(w)) AS n, array_to_string(w[p:p + least(8, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n))
SELECT DISTINCT doc_id FROM dw JOIN iw USING (n, s)""",
    "journal_state": "WITH j AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' ELSE event_type END AS event, floor(event_id / 40 + user_id % 2 * (event_id % 3)) AS g FROM events), p AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY run_id ORDER BY seq) > g, false) AS fell FROM j) SELECT run_id, arg_max(event, seq) AS last_event, count(*) AS events, CASE arg_max(event, seq) WHEN 'completed' THEN 'return_stored' ELSE 'refuse' END AS on_start, bool_or(fell) AS generation_falls FROM p GROUP BY run_id",
    "event_dead_letter": _DEAD + " SELECT answer_id, position, error IS NULL AS valid, coalesce(error, '') AS errors FROM e",
    "hypothesis_outcomes": _DEAD + """, n AS (SELECT r.answer_id, count(e.answer_id) FILTER (error IS NULL) AS v, count(error) AS i, CASE WHEN form = 0 THEN 1 ELSE 0 END AS s FROM r LEFT JOIN e USING (answer_id) GROUP BY r.answer_id, form)
SELECT answer_id, v AS valid_events, i AS invalid_events, v = 0 AND i = 0 AS abstention, s AS supported, 0 AS unsupported, 0 AS uncertain, v + i - s AS unreviewed, CASE WHEN s > v + i THEN 'more reviews than events' END AS error FROM n""",
    "json_contract": r"""WITH m AS (SELECT memory_id, lower(trim(intent, ' ')) AS intent, CASE WHEN intent IS NULL OR summary IS NULL OR model_confidence_unvalidated IS NULL THEN 'missing fields' WHEN len(list_filter(topics, lambda x: x IS NULL)) > 0 THEN 'invalid field topics' WHEN len(list_filter(decisions, lambda x: x IS NULL)) > 0 THEN 'invalid field decisions' WHEN len(list_filter(tasks, lambda x: x IS NULL)) > 0 THEN 'invalid field tasks'
  WHEN NOT regexp_matches(summary, '[^\s\x{a0}]') OR NOT model_confidence_unvalidated BETWEEN 0 AND 1 THEN 'invalid summary or confidence' WHEN lower(trim(intent, ' ')) NOT IN ('informational', 'planning', 'discussion', 'action', 'personal') THEN 'invalid intent' END AS error FROM memory_rows) SELECT memory_id, error, CASE WHEN error IS NULL THEN intent END AS intent FROM m""",
    "semantic_integrity": "SELECT memory_id, EXISTS (SELECT 1 FROM segments s WHERE s.video_id = m.video_id AND s.id = m.raw_transcript_segment_id) AS found FROM memory_rows m WHERE regexp_matches(searchable_text, '[^\\s\\x{a0}]')",
    "accepted_evidence_errors": _EV + " SELECT memory_id, errors FROM x",
    "answer_or_abstain": _EV + f", {_S}, m AS (SELECT segment_id, string_agg(trim(claim, ' '), ' ' ORDER BY memory_id) AS answer, count(*) AS n FROM s JOIN x ON x.video_id = s.video_id AND errors = '' AND start_sec <= b AND a <= end_sec GROUP BY segment_id) SELECT segment_id AS question_id, CASE WHEN n IS NULL THEN 'abstain' ELSE 'supported' END AS status, coalesce(n, 0)::INTEGER AS evidence, answer FROM s LEFT JOIN m USING (segment_id)",
    "sequence_states": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_sec, caption_id) - 1 AS n FROM captions WHERE isfinite(timestamp_sec) AND success IS DISTINCT FROM false AND frame_hash IS NOT NULL) SELECT video_id, n // 4 AS chunk, CASE WHEN count(*) > 1 AND count(DISTINCT frame_hash) = 1 THEN 'repeated_static_frames' WHEN count(*) <= 1 THEN 'single_frame' ELSE 'nonidentical_frames_unverified' END AS state FROM n GROUP BY ALL",
}
