"""Queries over candidate windows: the stream of events gives frames (user, time, value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.session import table


def _frames(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("v"))
    return W.frame_deltas(e, "v")


def frame_delta_lag(spark, folder):
    return _frames(spark, folder).select("id", "delta")


def sliding_window_metric(spark, folder):
    return W.window_metrics(_frames(spark, folder), 4).select("k", "start", "t0", "t1", F.round("metric", 5).alias("metric"))


def greedy_budget_select(spark, folder):
    return W.select_by_change(_frames(spark, folder)).where("selected").select("k", "candidate_id")


def greedy_budget_reasons(spark, folder):
    return W.select_by_change(_frames(spark, folder)).groupBy("reason").agg(F.count(F.lit(1)).alias("windows"))


def uniform_windows_select(spark, folder):
    return W.select_uniform(_frames(spark, folder)).where("selected").select("k", "candidate_id")


def anchored_select(spark, folder):
    return W.select_anchored(_frames(spark, folder)).where("selected").select("k", "candidate_id", "kind")


def _coverage(spark, folder):
    frames = _frames(spark, folder)
    spans = frames.groupBy("k").agg(F.min("t").alias("s0"), F.max("t").alias("s1"))
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    refs = table(spark, folder, "events").where("event_type = 'error'").select(F.col("user_id").alias("k"), F.col("event_id").alias("ref"), t.alias("r0"), (t + F.col("value") + 1).alias("r1"))
    return W.coverage(refs, spans, W.select_by_change(frames), W.select_uniform(frames))


def coverage_references(spark, folder):
    return _coverage(spark, folder).select("ref", "in_span", *[F.array_join(c, ",").alias(c) for c in ("change_ids", "uniform_ids", "change_containing", "uniform_containing")])


def coverage_summary(spark, folder):
    return W.coverage_summary(_coverage(spark, folder))


def control_sequences(spark, folder):
    w = W.select_uniform(_frames(spark, folder)).where("selected").select("candidate_id", "k", F.transform("ids", lambda i: i.cast("string")).alias("ids"), "times")
    return W.presentation_controls(w).select("k", "candidate_id", "input_order", F.array_join("frame_ids", ",").alias("frame_ids"), "presentation_times")


def clip_time_map(spark, folder):
    """Interval ends of every video's clip moved by its start."""
    c = F.col("clip_interval_seconds")
    v = table(spark, folder, "videos").where(F.size(c) == 2)
    return v.select("video_id", F.array_join(F.transform(W.source_times(F.array(F.lit(0.0), (c[1] - c[0]) / 2), c[0]), lambda x: F.round(x, 3)).cast("array<string>"), ",").isNotNull().alias("valid"), F.round(F.element_at(W.source_times(F.array(F.lit(0.0), (c[1] - c[0]) / 2), c[0]), 2), 3).alias("middle_sec"))


def visual_token_budget(spark, folder):
    grid = F.array(F.lit(2), (F.col("p_size") + 1).cast("int"), (F.col("p_partkey") % 40 + 1).cast("int"))
    return table(spark, folder, "part").select("p_partkey", W.visual_tokens(grid).alias("tokens")).where("tokens IS NOT NULL AND tokens <= 2304")


QUERIES = {f.__name__: f for f in (frame_delta_lag, sliding_window_metric, greedy_budget_select, greedy_budget_reasons, uniform_windows_select, anchored_select, coverage_references, coverage_summary, control_sequences, clip_time_map, visual_token_budget)}

_F = """WITH e AS (SELECT user_id AS k, event_id AS id, epoch_us(ts) / 1e6 AS t, value AS v FROM events),
f AS (SELECT *, round(abs(v - lag(v) OVER (PARTITION BY k ORDER BY t, id)), 6) AS delta, row_number() OVER (PARTITION BY k ORDER BY t, id) - 1 AS n, count(*) OVER (PARTITION BY k) AS c FROM e),
w AS (SELECT *, n AS start, lead(t, 3) OVER o AS t1, lead(id) OVER o AS i1, lead(id, 2) OVER o AS i2, lead(id, 3) OVER o AS i3, lead(t) OVER o AS u1, lead(t, 2) OVER o AS u2, round((lead(delta) OVER o + lead(delta, 2) OVER o + lead(delta, 3) OVER o) / 3, 6) AS metric FROM f WINDOW o AS (PARTITION BY k ORDER BY n)),
m AS (SELECT k, start, t AS t0, t1, u1, u2, metric, id, i1, i2, i3, c FROM w WHERE start + 4 <= c)"""
_U = """, uc AS (SELECT k, c, least({anchors}, 3, c - 3) AS cnt FROM (SELECT DISTINCT k, c FROM m)),
us AS (SELECT DISTINCT k, CASE WHEN cnt = 1 THEN 0 ELSE CAST(round_even(i * (c - 4) / (cnt - 1), 0) AS BIGINT) END AS start FROM (SELECT *, unnest(range(cnt)) AS i FROM uc))"""
_NEW = "len(list_filter(range(s, s + 4), lambda p: len(list_filter(acc, lambda a: p >= a AND p < a + 4)) = 0))"
_USED = "len(list_distinct(flatten(list_transform(acc, lambda a: range(a, a + 4)))))"
_G = f""", gl AS (SELECT k, list(start ORDER BY metric DESC, t0) AS l FROM m GROUP BY k),
g AS (SELECT k, unnest(list_reduce(l, lambda acc, s: CASE WHEN len(acc) >= 3 OR (len(acc) > 0 AND {_NEW} < 2) OR {_USED} + {_NEW} > 12 THEN acc ELSE list_append(acc, s) END, []::BIGINT[])) AS start FROM gl)"""
_CID = "format('{}_{{:04d}}_{{:04d}}', {}.start, {}.start + 3)"
_CHG, _UNI = _CID.format("change", "m", "m"), _CID.format("uniform", "m", "m")
_COV = (
    _F
    + _U.format(anchors=3)
    + _G
    + f""", sp AS (SELECT k, min(t) AS s0, max(t) AS s1 FROM e GROUP BY k),
r AS (SELECT user_id AS k, event_id AS ref, epoch_us(ts) / 1e6 AS r0, epoch_us(ts) / 1e6 + value + 1 AS r1 FROM events WHERE event_type = 'error'),
cs AS (SELECT m.k, m.start, {_CHG} AS cid, t0, t1, 'c' AS kind FROM m JOIN g USING (k, start) UNION ALL SELECT m.k, m.start, {_UNI}, t0, t1, 'u' FROM m JOIN us USING (k, start)),
cv AS (SELECT r.k, ref, any_value(r0 < s1 AND s0 < r1) AS in_span, coalesce(string_agg(cid, ',' ORDER BY start) FILTER (kind = 'c' AND r0 < t1 AND t0 < r1), '') AS change_ids, coalesce(string_agg(cid, ',' ORDER BY start) FILTER (kind = 'u' AND r0 < t1 AND t0 < r1), '') AS uniform_ids,
  coalesce(string_agg(cid, ',' ORDER BY start) FILTER (kind = 'c' AND t0 <= r0 AND t1 >= r1), '') AS change_containing, coalesce(string_agg(cid, ',' ORDER BY start) FILTER (kind = 'u' AND t0 <= r0 AND t1 >= r1), '') AS uniform_containing FROM r JOIN sp USING (k) LEFT JOIN cs ON cs.k = r.k GROUP BY r.k, ref)"""
)

SQL = {
    "frame_delta_lag": _F + " SELECT id, delta FROM f",
    "sliding_window_metric": _F + " SELECT k, start, t0, t1, round(metric, 5) AS metric FROM m",
    "greedy_budget_select": _F + _G + f" SELECT m.k, {_CHG} AS candidate_id FROM m JOIN g USING (k, start)",
    "greedy_budget_reasons": _F + _G + f""", rk AS (SELECT k, start AS s, row_number() OVER (PARTITION BY k ORDER BY metric DESC, t0) AS r FROM m), ch AS (SELECT rk.k, list(struct_pack(r := r, s := s)) AS c FROM rk JOIN g ON g.k = rk.k AND g.start = rk.s GROUP BY rk.k),
b AS (SELECT rk.k, s, list_transform(list_filter(c, lambda x: x.r < rk.r), lambda x: x.s) AS acc FROM rk JOIN ch USING (k))
SELECT CASE WHEN len(acc) >= 3 THEN '{W.CHANGE_REASONS["windows"]}' WHEN len(acc) > 0 AND {_NEW} < 2 THEN '{W.CHANGE_REASONS["novelty"]}' WHEN {_USED} + {_NEW} > 12 THEN '{W.CHANGE_REASONS["frames"]}' ELSE '{W.CHANGE_REASONS["selected"]}' END AS reason, count(*) AS windows FROM b GROUP BY 1""",
    "uniform_windows_select": _F + _U.format(anchors=3) + f" SELECT m.k, {_UNI} AS candidate_id FROM m JOIN us USING (k, start)",
    "anchored_select": _F
    + _U.format(anchors=2)
    + f""", al AS (SELECT k, list(start ORDER BY start) AS a FROM us GROUP BY k), gl AS (SELECT m.k, list(start ORDER BY metric DESC, t0) AS l FROM m GROUP BY m.k),
g AS (SELECT k, a, unnest(list_reduce(l, lambda acc, s: CASE WHEN list_contains(acc, s) OR len(acc) >= 3 OR {_NEW} < 2 OR {_USED} + {_NEW} > 12 THEN acc ELSE list_append(acc, s) END, a)) AS start FROM gl JOIN al USING (k))
SELECT m.k, {_CHG} AS candidate_id, CASE WHEN list_contains(g.a, m.start) THEN 'required_uniform_anchor' ELSE 'motion_fill' END AS kind FROM m JOIN g USING (k, start)""",
    "coverage_references": _COV + " SELECT ref, in_span, change_ids, uniform_ids, change_containing, uniform_containing FROM cv",
    "coverage_summary": _COV + " SELECT k, count(*) AS covered, sum((change_ids = '')::INT)::BIGINT AS dropped_by_change, sum((uniform_ids = '')::INT)::BIGINT AS dropped_by_uniform, sum((change_containing <> '')::INT)::BIGINT AS contained_by_change, sum((uniform_containing <> '')::INT)::BIGINT AS contained_by_uniform FROM cv WHERE in_span GROUP BY k",
    "control_sequences": _F + _U.format(anchors=3) + f", x AS (SELECT m.k, {_UNI} AS candidate_id, [m.id, i1, i2, i3] AS ids, [t0, u1, u2, t1] AS ts FROM m JOIN us USING (k, start)) SELECT k, candidate_id, input_order, array_to_string(CASE input_order WHEN 'source_chronological' THEN ids WHEN 'source_reverse' THEN list_reverse(ids) ELSE [ids[1], ids[1], ids[1], ids[1]] END, ',') AS frame_ids, CASE input_order WHEN 'source_chronological' THEN ts WHEN 'source_reverse' THEN list_reverse(ts) ELSE [ts[1], ts[1], ts[1], ts[1]] END AS presentation_times FROM x, (VALUES ('source_chronological'), ('source_reverse'), ('same_source_frame_repeated')) v(input_order)",
    "clip_time_map": "WITH v AS (SELECT video_id, clip_interval_seconds[1] AS a, clip_interval_seconds[2] AS b FROM videos WHERE len(clip_interval_seconds) = 2) SELECT video_id, coalesce(a >= 0 AND b > a, false) AS valid, CASE WHEN a >= 0 AND b > a THEN round(round(a + (b - a) / 2, 6), 3) END AS middle_sec FROM v",
    "visual_token_budget": "WITH g AS (SELECT p_partkey, 2 * (p_size + 1) * (p_partkey % 40 + 1) AS r FROM part) SELECT p_partkey, CAST(r // 4 AS BIGINT) AS tokens FROM g WHERE r % 4 = 0 AND r // 4 <= 2304",
}
