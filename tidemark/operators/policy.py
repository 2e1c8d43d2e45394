"""The evidence policy over tables: raw model hypotheses, what a frame sequence does not establish, answers or abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import HYPOTHESIS, first_error, nonblank, overlaps_closed, strip
from tidemark.operators.hypotheses import checked_evidence, sequence_state
from tidemark.operators.intervals import finite

# The reasons that go with each state of a frame sequence, the abstention, and the policy's record.
REASONS = {
    "repeated_static_frames": "All supplied frame hashes are identical; a temporal change claim is impossible from this sequence.",
    "single_frame": "One frame cannot establish a temporal change.",
    "nonidentical_frames_unverified": "Different frames establish neither action, causality, nor a temporal claim without independent accepted evidence.",
}
ABSTAIN = "I cannot establish that temporal claim from independently accepted evidence in the requested source-time range."
UNCALIBRATED = "not_calibrated"
POLICY = {"status": "experimental_not_calibrated", "forbidden_acceptance_signals": ["model confidence", "retrieval distance", "nonidentical frames"]}


def _text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def _or_null(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that the table has and the row fills; a null of text where it has none of them."""
    there = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def hypotheses(rows: DataFrame) -> DataFrame:
    """`rows` with a normal record of each raw model observation, and `error`: the first rule that it breaks, null for none.

    Taken are the times from source_pts_sec, else source_timestamps_sec; the text from raw_model_text, else observation, else caption;
    frame_ids, frame_hashes (null is none) and model_provenance (a map). Adds raw_text, pts, ids, hashes; a hypothesis is never accepted:
    verification_status and accepted_as_fact are set to that. Null fields break the rules that ask for them."""
    pts, text = _or_null(rows, "source_pts_sec", "source_timestamps_sec"), _or_null(rows, "raw_model_text", "observation", "caption")
    ids, p = F.col("frame_ids"), F.col("model_provenance")
    hashes = F.coalesce(F.col("frame_hashes"), F.array().cast("array<string>"))
    n = F.size(pts)
    steps = F.zip_with(F.slice(pts, 1, n - 1), F.slice(pts, 2, n - 1), lambda a, b: b >= a)
    some = F.coalesce((n > 0) & F.forall(pts, lambda t: finite(t)), F.lit(False))
    rules = {
        "not a model observation": F.col("source_type").eqNullSafe("model"),
        "times are not finite": some,
        "times are not in order": F.when(some & (n > 1), F.forall(steps, lambda x: x)).otherwise(True),
        "frames do not match times": (F.size(ids) == n) & F.forall(ids, _text),
        "no model and backend": _text(p["model"]) & _text(p["backend"]),
        "no model text": nonblank(text),
        "hashes do not match times": (F.size(hashes) == 0) | ((F.size(hashes) == n) & F.forall(hashes, _text)),
    }
    return rows.withColumns({"error": first_error(rules), "raw_text": strip(text), "pts": pts, "ids": ids, "hashes": hashes, "verification_status": F.lit(HYPOTHESIS), "accepted_as_fact": F.lit(False)})


def assessment(ids: Column, hashes: Column) -> Column:
    """What a frame sequence does not establish: its state, that it supports no change, and why."""
    state = sequence_state(ids, hashes)
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[state]
    return F.struct(state.alias("sequence_state"), F.lit(False).alias("can_support_temporal_change"), reason.alias("reason"))


def _by_ordinal(a: Column, b: Column) -> Column:
    return F.when(a.ordinal < b.ordinal, -1).when(a.ordinal > b.ordinal, 1).otherwise(0)


def answers(questions: DataFrame, raw: DataFrame, evidence: DataFrame) -> DataFrame:
    """One record per question (question_id, question, q0, q1): status, answer, source_time_range_sec, accepted_evidence,
    raw_hypotheses, temporal_assessments, confidence and error.

    `raw` are observations (question_id, ordinal and the fields of `hypotheses`), `evidence` records offered as accepted (question_id,
    ordinal and the fields that the evidence rules read). Everything is checked before anything is answered: the first broken rule of
    the question, its range, its hypotheses or its evidence, in their order, is `error`, and the record is otherwise null. Support comes
    from accepted evidence that overlaps the closed range, never from hypotheses; without it the question abstains. Lists hold what
    was supplied with that one question. A question without rows in the other tables has empty lists."""
    h = hypotheses(raw)
    record = F.struct(F.col("raw_text").alias("raw_model_text"), F.col("pts").alias("source_pts_sec"), F.col("ids").alias("frame_ids"), F.col("hashes").alias("frame_hashes"), "model_provenance", "verification_status", "accepted_as_fact")
    said = h.groupBy(F.col("question_id").alias("__hq")).agg(F.array_sort(F.collect_list(F.struct("ordinal", record.alias("r"), assessment(F.col("ids"), F.col("hashes")).alias("a"))), _by_ordinal).alias("h"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ordinal"))).alias("h_error"))
    e = checked_evidence(evidence).withColumn("first", F.get("errors", 0))
    proof = F.struct("evidence_id", strip(F.col("claim")).alias("claim"), F.array("start_sec", "end_sec").alias("source_time_range_sec"), "source_type", "acceptance_provenance")
    offered = e.groupBy(F.col("question_id").alias("__eq")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "start_sec", "end_sec", proof.alias("r"))), _by_ordinal).alias("e"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("ordinal"))).alias("e_error"))
    rows = questions.join(said, F.col("question_id") == F.col("__hq"), "left").join(offered, F.col("question_id") == F.col("__eq"), "left")
    rules = {"question must be nonempty": nonblank(F.col("question")), "requested range must be finite and ordered": finite(F.col("q0")) & finite(F.col("q1")) & (F.col("q0") <= F.col("q1"))}
    error = F.coalesce(first_error(rules), F.col("h_error"), F.col("e_error"))
    given = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    near = F.filter(given("e"), lambda x: overlaps_closed(x.start_sec, x.end_sec, F.col("q0"), F.col("q1")))
    done = rows.select("question_id", "q0", "q1", error.alias("error"), near.alias("near"), given("h").alias("h"))
    some = F.size("near") > 0
    only = lambda c: F.when(F.col("error").isNull(), c)
    return done.select(
        "question_id",
        "error",
        only(F.when(some, "supported").otherwise("abstain")).alias("status"),
        only(F.when(some, F.array_join(F.transform("near", lambda x: x.r.claim), " ")).otherwise(ABSTAIN)).alias("answer"),
        only(F.array("q0", "q1")).alias("source_time_range_sec"),
        only(F.transform("near", lambda x: x.r)).alias("accepted_evidence"),
        only(F.transform("h", lambda x: x.r)).alias("raw_hypotheses"),
        only(F.transform("h", lambda x: x.a)).alias("temporal_assessments"),
        only(F.lit(UNCALIBRATED)).alias("confidence"),
    )


def calibration_policy(spark: SparkSession) -> DataFrame:
    """The one record that says that no confidence or distance is calibrated."""
    return spark.range(1).select(F.lit(POLICY["status"]).alias("status"), F.array(*map(F.lit, POLICY["forbidden_acceptance_signals"])).alias("forbidden_acceptance_signals"))


def caption_documents(captions: DataFrame) -> DataFrame:
    """Captions as documents for retrieval: text, video_id, time_range (one instant), frame_timestamp_sec, frame_id, source_path, model,
    backend, device, observation, and the constants of a caption-only memory; `error` is the first rule that a row breaks.

    A row must be a model's, with a video, a finite time (source_timestamp_sec, else timestamp_sec) and a text that is not blank."""
    t = _or_null(captions, "source_timestamp_sec", "timestamp_sec")
    rules = {"no video": F.col("video_id").isNotNull(), "not a model observation": F.col("source_type").eqNullSafe("model"), "time is not finite": finite(t), "no caption": nonblank(F.col("caption"))}
    text = strip(F.col("caption"))
    rest = [_or_null(captions, c).alias(c) for c in ("frame_id", "source_path", "model", "backend", "device")]
    keep = ["caption_id"] if "caption_id" in captions.columns else []
    return captions.select(*keep, "video_id", text.alias("text"), F.array(t, t).alias("time_range"), t.alias("frame_timestamp_sec"), *rest, F.lit("model").alias("source_type"), F.lit(HYPOTHESIS).alias("verification_status"), F.lit(False).alias("accepted_as_fact"), F.lit("caption_only").alias("retrieval_mode"), F.lit("not_run").alias("asr_status"), text.alias("observation"), first_error(rules).alias("error"))
