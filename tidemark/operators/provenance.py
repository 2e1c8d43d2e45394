"""Provenance of decoded frames and of selections: hashes, contracts between runs, ordered look-ups, paths, envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import first_error
from tidemark.operators import windows as W
from tidemark.operators.intervals import finite
from tidemark.operators.numbering import numbered

# Most visual tokens of a registered input, and the statuses and scopes of selection records.
TOKEN_CAP = 2304
SELECTIONS = {
    "change": ("selection_measurement_not_event_evidence", "quality-filtered usable frames only; excluded manifest frames are retained below and are not silently treated as covered"),
    "uniform": ("uniform_selection_measurement_not_event_evidence", "quality-filtered usable frames only; excluded manifest frames are retained below and are not silently treated as covered"),
    "fixed": ("fixed_sampling_selection_measurement_not_event_evidence", "all fixed-rate decoded frames under the declared budget; dense scene frames are not pilot inputs"),
}
# The settings of a video preprocessor that go into a trace.
PREPROCESSOR = ("patch_size", "temporal_patch_size", "merge_size", "min_pixels", "max_pixels", "do_convert_rgb", "do_rescale", "rescale_factor", "do_normalize", "image_mean", "image_std", "fps", "min_frames", "max_frames")


def pixel_hash(mode: Column, size: Column, pixels: Column) -> Column:
    """SHA-256 of a decoded frame, its layout included, so that equal bytes of another layout differ; null without pixels."""
    return F.sha2(F.concat(F.encode(F.concat(F.coalesce(mode, F.lit("")), F.lit(":"), F.coalesce(size, F.lit("")), F.lit(":")), "UTF-8"), pixels), 256)


def frame_hashes(hashes: Column) -> Column:
    """A sequence's pixel hashes; none at all if any frame has none."""
    return F.when(F.coalesce(F.forall(hashes, lambda h: h.isNotNull()), F.lit(False)), hashes).otherwise(F.array().cast("array<string>"))


def preprocessor_contract(settings: Column) -> Column:
    """The fourteen recorded settings (a map of text) as a struct; what is not set is null."""
    return F.struct(*[settings[k].alias(k) for k in PREPROCESSOR])


def decode_trace(frames: DataFrame, key: str, order: str, expected: Column, start: Column) -> DataFrame:
    """(key, clip_times, source_times, hashes, error) of decoded frames (key, order, t, hash): the frames' times in the clip and in the
    source, and an error where their number is not the expected one or their times do not increase. A key's frames are one model input,
    a few dozen."""
    seen = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "t", "hash"))).alias("f"), F.max(expected).alias("n"), F.max(start).alias("s"))
    times = F.transform("f", lambda x: x.t)
    out = seen.select(key, times.alias("clip_times"), W.source_times(times, F.col("s")).alias("source_times"), frame_hashes(F.transform("f", lambda x: x.hash)).alias("hashes"), F.col("n"))
    return out.select(key, "clip_times", "source_times", "hashes", first_error({"frame count differs": F.size("clip_times") == F.col("n"), "times do not increase": F.col("source_times").isNotNull()}).alias("error"))


def preflight_errors(record: Column, trace: Column) -> Column:
    """The first way in which a prepared input departs from its registration. `record` has digest, registered_digest, frame_hashes,
    source_pts_sec and frame_count; `trace` has frame_hashes, source_pts_sec and tokens."""
    rules = {
        "record changed after registration": record.digest == record.registered_digest,
        "decoder hashes differ": trace.frame_hashes == record.frame_hashes,
        "source times differ": trace.source_pts_sec == record.source_pts_sec,
        "a frame is used again": F.size(F.array_distinct(trace.frame_hashes)) == record.frame_count,
        "too many visual tokens": trace.tokens <= TOKEN_CAP,
    }
    return first_error(rules)


def arm_differences(arms: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, arms, differences): the columns in which the arms of an experiment do not all agree; null equals null."""
    facts = [F.struct(F.countDistinct(c).alias("n"), F.count(c).alias("known")).alias(f"__{i}") for i, c in enumerate(columns)]
    rows = arms.groupBy(key).agg(F.count(F.lit(1)).alias("arms"), *facts)
    wrong = [F.when((F.col(f"__{i}.n") > 1) | ((F.col(f"__{i}.n") == 1) & (F.col(f"__{i}.known") < F.col("arms"))), F.lit(c)) for i, c in enumerate(columns)]
    return rows.select(key, "arms", F.array_compact(F.array(*wrong)).alias("differences"))


def ordered_lookup(lists: DataFrame, list_id: str, ids: str, records: DataFrame, record_id: str, order: str, value: str) -> DataFrame:
    """(list_id, values): for each id of a list, in the list's order, the value of its first record by `order`; null where there is none.
    Lists without ids give an empty list."""
    each = lists.select(list_id, F.posexplode_outer(ids).alias("pos", "id"))
    first = records.groupBy(F.col(record_id).alias("rid")).agg(F.min_by(F.col(value), F.col(order)).alias("value"))
    met = each.join(first, F.col("id") == F.col("rid"), "left")
    got = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "value"))))
    return met.groupBy(list_id).agg(got.alias("x")).select(list_id, F.transform("x", lambda s: s.value).alias("values"))


def reference_of_kind(references: Column, kind: Column) -> Column:
    """The first of a record's reference annotations of a kind; null if it has none."""
    return F.get(F.filter(references, lambda r: r.kind == kind), 0)


def reference_interval(first: Column, second: Column) -> Column:
    """An interval under either of two names (the first wins): two finite, strictly increasing times, else null."""
    x = F.coalesce(first, second)
    ok = (F.size(x) == 2) & finite(F.get(x, 0)) & finite(F.get(x, 1)) & (F.get(x, 1) > F.get(x, 0))
    return F.when(F.coalesce(ok, F.lit(False)), x)


def contained_path(path: Column) -> Column:
    """Whether a relative path stays inside its folder: each step up is preceded by one down, and something is named. Links are not
    followed here; what reads the files must."""
    step = lambda d, p: F.when(d < 0, d).when(p.isin("", "."), d).when(p == "..", d - 1).otherwise(d + 1)
    depth = F.aggregate(F.split(path, "/"), F.lit(0), step)
    return F.coalesce(~path.startswith("/") & (depth > 0) & ~path.contains("\\") & ~path.contains("\0"), F.lit(False))


def pair_times(files: DataFrame, times: DataFrame, key: str, file_order: str, time_order: Sequence[str]) -> DataFrame:
    """(key, n, file, t, error): the n-th extracted file of a key with its n-th parsed time; keys whose counts differ have an error in
    every row, and null where one side has no more."""
    a = numbered(files.select(key, file_order), key, [file_order])
    b = numbered(times.select(key, *time_order), key, list(time_order))
    count = lambda df, name: df.groupBy(F.col(key).alias(f"__{name}k")).agg(F.count(F.lit(1)).alias(name))
    right = b.select(F.col(key).alias("__k"), F.col("n").alias("__n"), F.col(time_order[0]).alias("t"))
    both = a.join(right, F.col(key).eqNullSafe(F.col("__k")) & (F.col("n") == F.col("__n")), "full")
    k = F.coalesce(F.col(key), F.col("__k"))
    rows = both.select(k.alias(key), F.coalesce("n", "__n").alias("n"), F.col(file_order).alias("file"), "t")
    counted = rows.join(count(a, "fa"), F.col(key).eqNullSafe(F.col("__fak")), "left").join(count(b, "fb"), F.col(key).eqNullSafe(F.col("__fbk")), "left")
    return counted.select(key, "n", "file", "t", F.when(~F.coalesce("fa", F.lit(0)).eqNullSafe(F.coalesce("fb", F.lit(0))), F.lit("frame and time counts differ")).alias("error"))


def scene_frames(frames: DataFrame, score: str, threshold: float = 0.2) -> DataFrame:
    """Frames whose scene score is above the threshold; null and NaN scores are not."""
    return frames.where(F.coalesce(finite(F.col(score)) & (F.col(score) > threshold), F.lit(False)))


def merged_maps(base: Column, update: Column) -> Column:
    """Two maps as one; where both have a key the second wins. Null maps are empty."""
    b, u = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (base, update))
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(u, k)), u)


def select_windows(frames: DataFrame, mode: str, source: str = "fixed", **budget) -> DataFrame:
    """The selectors under one name, as self-describing records: mode change, uniform or anchored_change. `source` is 'fixed' for a frozen
    fixed-rate budget, else the mode names the record. A mode that is not known is an error, in every source."""
    choose = {"change": W.select_by_change, "uniform": W.select_uniform, "anchored_change": W.select_anchored}
    if mode not in choose or source not in ("fixed", "manifest"):
        raise ValueError("mode must be change, uniform or anchored_change, and source fixed or manifest")
    status, scope = SELECTIONS["fixed" if source == "fixed" else "uniform" if mode == "uniform" else "change"]
    return choose[mode](frames, **budget).withColumns({"source_type": F.lit("instrumented_measurement"), "accepted_as_fact": F.lit(False), "verification_status": F.lit(status), "selection_scope": F.lit(scope), "mode": F.lit(mode)})
