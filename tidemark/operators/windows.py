"""Candidate windows over ordered frames: metrics, ranks, budgeted greedy and uniform selection, reference coverage.

Frames are (k, id, t, delta): key, unique id, time, and the change against the frame before it (null for the first). A selection holds
at most `max_windows` windows per key, so it is an array on one row per key; greedy scans fold a fixed number of candidates per key,
never all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import even_position, numbered_id, overlaps_open, round6
from tidemark.operators.numbering import numbered, row_windows, spread_join
from tidemark.operators.ordered import chunked, previous_row
from tidemark.session import cut

# Reasons of the selectors.
CHANGE_REASONS = {
    "selected": "selected by highest transparent luma-change metric within window and unique-frame budgets",
    "windows": "not selected: maximum candidate-window count reached",
    "novelty": "not selected: insufficient novel frames for temporal coverage diversity",
    "frames": "not selected: adding unique frames would exceed frame budget",
}
ANCHORED_REASONS = {
    "anchor": "selected as required uniform temporal anchor before motion ranking",
    "selected": "selected by transparent motion metric only after required uniform anchors",
    "windows": "not selected: all remaining budget slots are exhausted after required anchors",
    "novelty": "not selected: insufficient novel frames after required anchor coverage",
    "frames": "not selected: would exceed unique-frame budget after required anchors",
}
UNIFORM_REASONS = {
    "selected": "selected by evenly distributed source-frame position under the same window/frame budget",
    "other": "not selected by fixed uniform source-frame positions",
}


def check_budget(size: int, max_windows: int, max_frames: int, novelty: int | None = None, anchors: int | None = None) -> int:
    """The novelty rule's value; raises ValueError for parameters out of their ranges."""
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not whole(size) or size < 2 or not whole(max_windows) or max_windows < 1 or not whole(max_frames) or max_frames < size:
        raise ValueError("window size of at least 2, one window or more, and a frame budget of at least one window are needed")
    novelty = max(1, size // 2) if novelty is None else novelty
    if not whole(novelty) or not 1 <= novelty <= size:
        raise ValueError("novelty must be within the window size")
    if anchors is not None and (not whole(anchors) or not 1 <= anchors <= max_windows):
        raise ValueError("anchors must be between one and the number of windows")
    return novelty


def frame_deltas(frames: DataFrame, value: str) -> DataFrame:
    """(k, id, t, delta): the absolute change of `value` against the frame before it by (t, id), rounded; null for a key's first."""
    order = ["k", "t", "id"]
    rows = previous_row(chunked(frames.select("k", "t", "id", F.col(value).alias("v")), order), order, ["k", "v"])
    same = F.col("prev.k").eqNullSafe(F.col("k")) & F.col("prev").isNotNull()
    return rows.select("k", "id", "t", F.when(same, round6(F.abs(F.col("v") - F.col("prev.v")))).alias("delta"))


def frame_errors(frames: DataFrame) -> DataFrame:
    """Frames that no selector takes: (k, id, t, error) for repeated ids, times that are not finite, repeated times of a key."""
    bad = F.when(F.col("t").isNull() | F.isnan("t") | (F.abs("t") == float("inf")), "time is not finite")
    ids = frames.groupBy("k", "id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t")).where("n > 1").select("k", "id", "t", F.lit("frame id repeated").alias("error"))
    times = frames.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1").select("k", "id", "t", F.lit("times do not increase").alias("error"))
    return frames.select("k", "id", "t", bad.alias("error")).where("error IS NOT NULL").unionByName(ids).unionByName(times)


def window_metrics(frames: DataFrame, size: int) -> DataFrame:
    """(k, start, t0, t1, ids, times, metric) of every complete window: the mean of the changes after its first frame. Keys with fewer frames
    than `size` have none."""
    rows = row_windows(frames.select("k", "t", "id", "delta"), "k", ["t", "id"], size, ["t", "id", "delta"])
    later = F.slice("rows", 2, size - 1)
    total = F.aggregate(later, F.lit(0.0), lambda s, r: s + r.delta)
    return rows.select("k", "start", F.element_at("rows", 1)["t"].alias("t0"), F.element_at("rows", -1)["t"].alias("t1"), F.transform("rows", lambda r: r.id).alias("ids"), F.transform("rows", lambda r: r.t).alias("times"), round6(total / (size - 1)).alias("metric"))


def ranked_windows(frames: DataFrame, size: int) -> DataFrame:
    """Windows with their rank from 1 by metric (large first), then time."""
    return cut(numbered(window_metrics(frames, size), "k", ["metric", "t0"], "n", descending=["metric"]).withColumn("rank", F.col("n") + 1).drop("n"))


def _new_frames(start: Column, chosen: Column, size: int) -> Column:
    return F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: start + i), lambda p: ~F.exists(chosen, lambda s: (p >= s.start) & (p < s.start + size))))


def _used(chosen: Column, size: int) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(chosen, lambda s: F.sequence(s.start, s.start + size - 1)))))


_CHOSEN = "array<struct<rank:bigint,start:bigint>>"


def _pick(candidates: Column, chosen: Column, size: int, max_windows: int, max_frames: int, novelty: int, first_free: bool, roomy: bool) -> Column:
    """`chosen` and what the greedy rule adds to it from candidates in order of rank; with `roomy` only while a whole window more would fit."""

    def step(c: Column, w: Column) -> Column:
        new, used = _new_frames(w.start, c, size), _used(c, size)
        novel = (new >= novelty) | (F.size(c) == 0) if first_free else new >= novelty
        fits = (F.size(c) < max_windows) & ~F.exists(c, lambda s: s.start == w.start) & novel & (used + new <= max_frames)
        return F.when(fits & (used + size <= max_frames) if roomy else fits, F.concat(c, F.array(w))).otherwise(c)

    return F.aggregate(candidates, chosen, step)


def _greedy(windows: DataFrame, state: DataFrame, size: int, max_windows: int, max_frames: int, novelty: int, first_free: bool) -> DataFrame:
    """`state` is (key, w, chosen) with one row per key; the result has in `chosen` all that is taken.

    While a whole window more fits the frame budget, a window can only be left out for overlapping a taken one, and each taken one has
    at most 2 * size - 1 windows that overlap it: the next one taken is among the best ranks of a fixed number, which are folded as one
    list per key. Once no whole window fits, only windows that overlap taken ones can, so those near to these are folded likewise.
    """
    best = max_windows * (2 * size - 1) + 1
    row = F.struct(F.col("rank").cast("long").alias("rank"), F.col("start").cast("long").alias("start"))
    top = windows.where(F.col("rank") <= best).groupBy("k").agg(F.array_sort(F.collect_list(row)).alias("__top"))
    met = state.join(top, F.col("key").eqNullSafe(F.col("k")), "left").withColumn("__top", F.coalesce("__top", F.array().cast(_CHOSEN)))
    state = cut(met.select("key", "w", _pick(F.col("__top"), F.col("chosen"), size, max_windows, max_frames, novelty, first_free, True).alias("chosen")))
    if max_windows * size <= max_frames:  # the budget never gets tight
        return state
    last = F.coalesce(F.array_max(F.transform("chosen", lambda s: s.rank)), F.lit(0))
    near = F.array_distinct(F.flatten(F.transform("chosen", lambda s: F.sequence(F.greatest(s.start - max_windows * size, F.lit(0)), s.start + max_windows * size))))
    tight = state.where((F.size("chosen") < max_windows) & (F.size("chosen") > 0)).select("key", last.alias("last"), F.explode(near).alias("at"))
    found = windows.select("k", "rank", "start").join(tight, F.col("k").eqNullSafe(F.col("key")) & (F.col("start") == F.col("at"))).where(F.col("rank") > F.col("last"))
    more = found.groupBy(F.col("k").alias("__k")).agg(F.array_sort(F.collect_list(row)).alias("__more"))
    rows = state.join(more, F.col("key").eqNullSafe(F.col("__k")), "left")
    return cut(rows.select("key", "w", F.when(F.col("__more").isNull(), F.col("chosen")).otherwise(_pick(F.col("__more"), F.col("chosen"), size, max_windows, max_frames, novelty, first_free, False)).alias("chosen")))


def select_by_change(frames: DataFrame, size: int = 4, max_windows: int = 3, max_frames: int = 12, novelty: int | None = None) -> DataFrame:
    """Every window with rank, selected and reason: in order of rank, a window is taken unless there are `max_windows` already, it has
    fewer than `novelty` new frames (half a window by default; the first is free), or the distinct frames would exceed `max_frames`.

    Output: k, candidate_id, start, t0, t1, ids, metric, rank, selected, reason.
    """
    novelty = check_budget(size, max_windows, max_frames, novelty)
    windows = ranked_windows(frames, size)
    state = cut(windows.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("w")).withColumn("chosen", F.array().cast(_CHOSEN)))
    state = _greedy(windows, state, size, max_windows, max_frames, novelty, True)
    joined = spread_join(windows, state, "k", "key", "w", "rank")
    before = F.filter("chosen", lambda s: s.rank < F.col("rank"))
    new = _new_frames(F.col("start"), before, size)
    reason = (
        F.when(F.size(before) >= max_windows, CHANGE_REASONS["windows"])
        .when((F.size(before) > 0) & (new < novelty), CHANGE_REASONS["novelty"])
        .when(_used(before, size) + new > max_frames, CHANGE_REASONS["frames"])
        .otherwise(CHANGE_REASONS["selected"])
    )
    taken = F.exists("chosen", lambda s: s.start == F.col("start"))
    return joined.select("k", numbered_id("change", F.col("start"), F.col("start") + (size - 1)).alias("candidate_id"), "start", "t0", "t1", "ids", "times", "metric", "rank", taken.alias("selected"), reason.alias("reason"))


def uniform_starts(count: Column, size: int, max_windows: int, max_frames: int) -> Column:
    """First frames of evenly spread windows over `count` frames, given that they hold at least one window."""
    last = count - size
    n = F.least(F.lit(min(max_windows, max_frames // size)), last + 1).cast("int")
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: even_position(i, last, n).cast("long")))
    return F.when(n <= 1, F.array(F.lit(0).cast("long"))).otherwise(many)


def select_uniform(frames: DataFrame, size: int = 4, max_windows: int = 3, max_frames: int = 12) -> DataFrame:
    """Every window with selected and reason, chosen by evenly distributed positions."""
    check_budget(size, max_windows, max_frames)
    windows = window_metrics(frames.withColumn("delta", F.lit(0.0)), size).drop("metric")
    per = frames.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= size).withColumn("starts", uniform_starts(F.col("w"), size, max_windows, max_frames))
    joined = spread_join(windows, cut(per), "k", "key", "w", "start")
    taken = F.array_contains("starts", F.col("start").cast("long"))
    return joined.select("k", numbered_id("uniform", F.col("start"), F.col("start") + (size - 1)).alias("candidate_id"), "start", "t0", "t1", "ids", "times", taken.alias("selected"), F.when(taken, UNIFORM_REASONS["selected"]).otherwise(UNIFORM_REASONS["other"]).alias("reason"))


def select_anchored(frames: DataFrame, size: int = 4, max_windows: int = 3, max_frames: int = 12, anchors: int = 2, novelty: int | None = None) -> DataFrame:
    """Uniform anchors first, then windows by rank for the slots and frames that remain; kind says which. Output as select_by_change,
    with kind."""
    novelty = check_budget(size, max_windows, max_frames, novelty, anchors)
    windows = ranked_windows(frames, size)
    per = frames.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= size)
    starts = F.transform(uniform_starts(F.col("w"), size, anchors, max_frames), lambda s: F.struct(F.lit(0).cast("long").alias("rank"), s.alias("start")))
    state = _greedy(windows, cut(per.select("key", "w", starts.alias("chosen"))), size, max_windows, max_frames, novelty, False)
    joined = spread_join(windows, state, "k", "key", "w", "rank")
    anchor = F.exists("chosen", lambda s: (s.rank == 0) & (s.start == F.col("start")))
    taken = F.exists("chosen", lambda s: s.start == F.col("start"))
    before = F.filter("chosen", lambda s: s.rank < F.col("rank"))
    new = _new_frames(F.col("start"), before, size)
    reason = (
        F.when(anchor, ANCHORED_REASONS["anchor"])
        .when(F.size(before) >= max_windows, ANCHORED_REASONS["windows"])
        .when(new < novelty, ANCHORED_REASONS["novelty"])
        .when(_used(before, size) + new > max_frames, ANCHORED_REASONS["frames"])
        .otherwise(ANCHORED_REASONS["selected"])
    )
    kind = F.when(anchor, "required_uniform_anchor").when(taken, "motion_fill").otherwise("motion_candidate")
    return joined.select("k", numbered_id("change", F.col("start"), F.col("start") + (size - 1)).alias("candidate_id"), "start", "t0", "t1", "ids", "times", "metric", "rank", taken.alias("selected"), kind.alias("kind"), reason.alias("reason"))


def coverage(references: DataFrame, spans: DataFrame, change: DataFrame, uniform: DataFrame) -> DataFrame:
    """What selections cover of reference intervals (k, ref, r0, r1), evaluation only.

    `spans` is (k, s0, s1), the full decoded range of a key. Output: k, ref, in_span, and for both selections the ids of windows that
    overlap the interval (open: touching is none) and of those that contain it (closed), in order. Intervals of keys without any
    selection are covered by nothing.
    """

    def chosen(sel: DataFrame, name: str) -> DataFrame:
        return sel.where("selected").groupBy(F.col("k").alias(f"{name}_k")).agg(F.array_sort(F.collect_list(F.struct("start", "candidate_id", "t0", "t1"))).alias(name))

    rows = references.join(spans, "k", "left").join(chosen(change, "c"), F.col("k") == F.col("c_k"), "left").join(chosen(uniform, "u"), F.col("k") == F.col("u_k"), "left")
    r0, r1 = F.col("r0"), F.col("r1")
    ids = lambda c, rule: F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<struct<start:bigint,candidate_id:string,t0:double,t1:double>>")), rule), lambda w: w.candidate_id)
    over, inside = (lambda w: overlaps_open(r0, r1, w.t0, w.t1)), (lambda w: (w.t0 <= r0) & (w.t1 >= r1))
    return rows.select("k", "ref", F.coalesce(overlaps_open(r0, r1, F.col("s0"), F.col("s1")), F.lit(False)).alias("in_span"), ids("c", over).alias("change_ids"), ids("u", over).alias("uniform_ids"), ids("c", inside).alias("change_containing"), ids("u", inside).alias("uniform_containing"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Counts over the references within the decoded span."""
    some = lambda c: F.sum(F.when(F.size(c) > 0, 1).otherwise(0))
    none = lambda c: F.sum(F.when(F.size(c) == 0, 1).otherwise(0))
    return covered.where("in_span").groupBy("k").agg(F.count(F.lit(1)).alias("covered"), none("change_ids").alias("dropped_by_change"), none("uniform_ids").alias("dropped_by_uniform"), some("change_containing").alias("contained_by_change"), some("uniform_containing").alias("contained_by_uniform"))


def presentation_controls(windows: DataFrame, ids: str = "ids", times: str = "times") -> DataFrame:
    """Forward, reverse and repeated-still presentations of each window, as three rows each."""
    i, t = F.col(ids), F.col(times)
    one = lambda name, a, b: F.struct(F.lit(name).alias("input_order"), a.alias("frame_ids"), b.alias("presentation_times"))
    still = lambda c: F.array_repeat(F.element_at(c, 1), F.size(c))
    return windows.withColumn("p", F.explode(F.array(one("source_chronological", i, t), one("source_reverse", F.reverse(i), F.reverse(t)), one("same_source_frame_repeated", still(i), still(t))))).select(*windows.columns, "p.*")


def source_times(clip_times: Column, start: Column) -> Column:
    """Clip times as source times, rounded; null unless they increase and the start is not negative."""
    out = F.transform(clip_times, lambda t: round6(start + t))
    n = F.size(out)
    rising = F.forall(F.sequence(F.lit(1), n), lambda i: (i >= n) | (F.get(out, i) > F.get(out, i - 1)))
    return F.when((n > 0) & (start >= 0) & rising, out)


def visual_tokens(grid: Column) -> Column:
    """Merged tokens of a [time, height, width] grid of patches; null unless it has three positive sides and divides by four."""
    rows = F.get(grid, 0) * F.get(grid, 1) * F.get(grid, 2)
    return F.when((F.size(grid) == 3) & F.forall(grid, lambda x: x > 0) & (rows % 4 == 0), (rows / 4).cast("long"))
