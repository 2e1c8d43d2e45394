"""Model answers, policy and contracts: the literal fixtures."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import hypotheses as H
from tidemark.plans import checks

FOLDER = "/root/testdata/sf0.01"

IDS, PTS = [f"f{i}.jpg" for i in range(4)], [0.0, 1.0, 2.0, 3.0]


def event(**k):
    return {"event_id": "e1", "verb": "lift", "object": "pan", "actor": "wearer", "direction": "up", "uncertain": False} | k


def ingest(spark, answers, order="source_chronological", assign=False, ids=IDS, pts=PTS):
    rows = [(i, a if isinstance(a, str) or a is None else json.dumps(a), ids, pts, order) for i, a in enumerate(answers)]
    return H.ingest_events(spark.createDataFrame(rows, "answer_id long, raw_model_text string, frame_ids array<string>, source_pts_sec array<double>, input_order string"), assign).collect()


def test_indices(spark):
    got = ingest(spark, [{"events": [event(evidence_frame_indices=x)]} for x in ([1, 3], ["1", "3"], ["1.0", 99], [1], [True, 2], [2, 2], [0, 9], [3, 1])])
    assert [r.valid for r in got] == [True, True, False, False, False, False, False, False]
    assert (got[0].t0, got[0].t1, got[0].frame_ids) == (1.0, 3.0, ["f1.jpg", "f3.jpg"]) and not got[0].accepted_as_fact


def test_exact_evidence_and_dead_letter(spark):
    ok = {"frame_id": "f1.jpg", "source_pts_sec": 1.0000005}
    got = ingest(spark, [{"events": [event(evidence=[ok])]}, {"events": [event(evidence=[{"frame_id": "no", "source_pts_sec": 1}])]}, "{", {"events": {}}, [], {"events": ["x"]}, {"events": [event(evidence=[])]}, None, {"events": [event(evidence=[ok, ok])]}, {"events": [event(actor=[])]}])
    assert [r.valid for r in got] == [True] + [False] * 9
    assert got[2].position == 0 and got[5].errors == ["event must be an object"]


def test_ids(spark):
    e = event(evidence_frame_indices=[0, 1])
    no = {k: v for k, v in e.items() if k != "event_id"}
    assert ingest(spark, [{"events": [no]}], assign=True)[0].event_id == "model_event_01"
    # an id is only taken by a valid event
    got = ingest(spark, [{"events": [e | {"verb": ""}, e, e]}])
    assert [r.valid for r in got] == [False, True, False] and got[2].errors == ["event_id must be unique within a response"]


def test_reverse_presentation(spark):
    got = ingest(spark, [{"events": [event(evidence_frame_indices=[0, 2])]}], order="source_reverse", ids=IDS[2::-1], pts=PTS[2::-1])
    assert got[0].valid and (got[0].t0, got[0].t1) == (0.0, 2.0)


def test_outcomes(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "answer_id long")
    e = spark.createDataFrame([(1, True), (1, False), (3, True)], "answer_id long, valid boolean")
    r = spark.createDataFrame([(1, "unsupported"), (3, "supported"), (3, "uncertain")], "answer_id long, status string")
    got = {x.answer_id: x for x in H.hypothesis_outcomes(a, e, r).collect()}
    assert (got[1].valid_events, got[1].invalid_events, got[1].unsupported, got[1].unreviewed, got[1].error) == (1, 1, 1, 1, None)
    assert got[2].abstention and got[3].error == "more reviews than events"


def test_semantics(spark):
    good = {"topics": ["a"], "decisions": [], "tasks": [], "people": [], "entities": [], "intent": "action", "summary": "s", "confidence": 0.5, "context_block_id": "evil"}
    bad = [good | {"confidence": True}, good | {"confidence": 2}, good | {"summary": " "}, good | {"intent": "x"}, good | {"topics": [1]}, {}, []]
    texts = [json.dumps(good), "```json\n" + json.dumps(good) + "\n```", *map(json.dumps, bad), "{", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(H.parse_semantics(F.col("t")).alias("p")).collect()]
    assert [p.error is None for p in got] == [True, True] + [False] * 9 and got[0].topics == ["a"] and "context_block_id" not in got[0].asDict()


def test_policy(spark):
    q = spark.createDataFrame([(1, "v", 0.0, 1.0), (2, "v", 2.0, 3.0), (3, "w", 0.0, 1.0), (4, "v", 5.0, 1.0), (5, "v", None, 1.0), (6, "v", 0.0, 500.0)], "question_id long, video_id string, q0 double, q1 double")
    e = spark.createDataFrame([("v", 2, 0.9, 1.5, "b"), ("v", 1, 0.5, 0.8, "a"), ("v", 3, 100.0, 300.0, "c")], "video_id string, ordinal long, start_sec double, end_sec double, claim string")
    got = {r.question_id: (r.status, r.evidence, r.answer) for r in H.answer_ranges(q, e).collect()}
    assert got == {1: ("supported", 2, "a b"), 2: ("abstain", 0, None), 3: ("abstain", 0, None), 4: ("invalid_range", 0, None), 5: ("invalid_range", 0, None), 6: ("supported", 3, "a b c")}


def test_states_controls_questions(spark):
    df = spark.createDataFrame([(["a", "b"], ["h", "h"]), (["a"], ["h"]), (["a", "b"], ["h", "g"]), (["a", "b"], [])], "i array<string>, h array<string>")
    assert [r[0] for r in df.select(H.sequence_state(F.col("i"), F.col("h"))).collect()] == ["repeated_static_frames", "single_frame", "nonidentical_frames_unverified", "nonidentical_frames_unverified"]
    df = spark.createDataFrame([(["a", "b"], ["b", "a"], ["a", "a"]), (["a", "b"], ["a", "b"], ["b", "b"])], "f array<string>, r array<string>, s array<string>")
    got = [r[0] for r in df.select(H.control_errors(F.col("f"), F.col("r"), F.col("s"))).collect()]
    assert got == [[], ["reverse is not the reversed forward", "still is not the first frame"]]
    q = spark.createDataFrame([("q", 5, None, None), (" ", 5, None, None), ("q", 11, None, None), ("q", 5, 1.0, None), ("q", 5, 2.0, 1.0), ("x" * 1001, 5, None, None), ("q", 5, 0.0, 1.0)], "question string, limit int, start_sec double, end_sec double")
    assert [r.error is None for r in H.questions_checked(q).collect()] == [True, False, False, False, False, False, True]


def test_manifest(spark):
    good = dict(video_id="P02_05", split="s", license_id="l", source_url="https://a.example/x", timestamp_unit="seconds", timestamp_origin="source_video_start", source_duration_seconds=10.0, clip_interval_seconds=[0.0, 10.0], size_bytes=None, sha256=None, verification_status="pending")
    spoil = [{"clip_interval_seconds": [3.0, 3.0]}, {"clip_interval_seconds": [0.0, 11.0]}, {"clip_interval_seconds": [0.0]}, {"source_url": "http://a"}, {"video_id": "../x"}, {"verification_status": "verified"}, {"sha256": "zz"}, {"size_bytes": 0}, {"split": " "}, {"source_duration_seconds": float("nan")}]
    rows = [good] + [good | {"video_id": f"v{i}"} | s for i, s in enumerate(spoil)] + [good | {"video_id": "twice"}] * 2
    df = spark.createDataFrame(rows, "video_id string, split string, license_id string, source_url string, timestamp_unit string, timestamp_origin string, source_duration_seconds double, clip_interval_seconds array<double>, size_bytes long, sha256 string, verification_status string")
    got = C.manifest_violations(df).collect()
    ok = [r.video_id for r in got if not r.violations]
    assert ok == ["P02_05"] and {tuple(r.violations) for r in got if r.video_id == "twice"} == {("unique video_id",)}


def test_references(spark):
    ann = [("v", "1", "00:00:01.25", "00:00:03.5", "cut"), ("v", "2", "00:00:05", "00:00:06", "touching"), ("v", "3", "00:00:03", "00:00:02", "x"), ("v", "4", "1", "00:00:02", "x"), ("v", "5", "00:00:01", "00:00:02", " "), ("v", "6", "00:00:01", "00:00:02", "a"), ("v", "6", "00:00:01", "00:00:02", "b"), ("v", "7", "00:00:01", "00:01:02", "late"), ("w", "8", "x", "y", "other")]
    good, bad = C.clip_references(spark.createDataFrame(ann, "video_id string, annotation_id string, start_text string, stop_text string, label string"), spark.createDataFrame([("v", [2.0, 5.0], 10.0)], "video_id string, clip_interval_seconds array<double>, source_duration_seconds double"))
    assert [(r.annotation_id, r.clip_start, r.clip_end) for r in good.collect()] == [("1", 0.0, 1.5)]
    assert sorted(r.annotation_id for r in bad.collect()) == ["3", "4", "5", "6", "6", "7"]


def test_sources_and_runs(spark):
    r = spark.createDataFrame([("a", 5, "d" * 64, 1.0), ("b", 5, "d" * 64, 1.0)], "video_id string, size_bytes long, sha256 string, source_duration_seconds double")
    o = spark.createDataFrame([("a", 5, "d" * 64, 1.0005)], "video_id string, size long, digest string, seconds double")
    got = {x.video_id: x.differences for x in C.verify_sources(r, o).collect()}
    assert got["a"] == [] and "present" in got["b"]
    j = spark.createDataFrame([("r", 1, "running", 0), ("r", 2, "completed", 3), ("s", 1, "running", 2), ("s", 2, "failed_or_interrupted", 1)], "run_id string, seq long, event string, generation long")
    assert {x.run_id: (x.on_start, x.generation_falls) for x in C.run_state(j).collect()} == {"r": ("return_stored", False), "s": ("refuse", True)}


def test_firewall_finds_every_part_of_a_label(spark):
    w = [f"w{i}" for i in range(20)]
    labels = spark.createDataFrame([(" ".join(w),), ("Lift the Pan!",), ("...",), (None,)], "text string")
    texts = {1: w[:8], 2: w[6:14], 3: w[12:], 4: w[:7] + ["x"] + w[7:14], 5: ["a", "lift", "THE", "pan", "b"], 6: ["lift", "pan"], 7: ["the"], 8: []}
    docs = spark.createDataFrame([(i, ", ".join(t)) for i, t in texts.items()] + [(9, None)], "doc_id long, text string")
    assert {r.doc_id for r in C.label_leaks(labels, docs).collect()} == {1, 2, 3, 5}
    assert C.label_leaks(labels.where("text = '...'"), docs).count() == 0 == C.label_leaks(labels, docs.limit(0)).count()


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_firewall_equals_plain_reading(spark):
    """All 8-word runs of the items, and the shorter items whole, looked for one by one."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "eval_items"))
    runs = {tuple(w[i : i + 8]) for w in (words(r.text) for r in items.collect() if r.text) for i in range(max(1, len(w) - 7)) if w}
    lengths = {len(x) for x in runs}
    want = {r.doc_id for r in docs.collect() if r.text for w in [words(r.text)] if any(tuple(w[i : i + n]) in runs for n in lengths for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in checks.label_firewall(spark, FOLDER).collect()} == want and want
