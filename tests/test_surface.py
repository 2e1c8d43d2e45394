"""Sources, sinks, adapters, pipeline, service, streams, configuration."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import adapters, sources
from tidemark.config import load_config, merged
from tidemark.pipeline import Pipeline, phase_range
from tidemark.service import QuestionService, checked_question, respond
from tidemark.sources import sinks
from tidemark.streaming import merge_rows, rate_limited_stream, replace_stream

CAP = "caption_id long, video_id string, frame_id string, timestamp_sec double, source_timestamp_sec double, source_path string, caption string, success boolean, source_type string, model string, backend string, device string, frame_hash string"
SEG = "segment_id long, video_id string, id long, start_sec double, end_sec double, text string, no_speech_prob double, source_type string"


def test_config(tmp_path):
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    p = tmp_path / "c.yaml"
    p.write_text("pipeline:\n  time_window_sec: 5\n")
    c = load_config(str(p), {"TIDEMARK_RAW_DIR": "/r"})
    assert c["pipeline.time_window_sec"] == 5 and c["paths.raw_dir"] == "/r" and c["embeddings.dimension"] == 384
    p.write_text("pipeline:\n  frame_sampling_fps: 0\n")
    with pytest.raises(ValueError):
        load_config(str(p), {})


def test_video_listing(spark, tmp_path):
    for n in ("P1.MP4", "P10.mov", "x.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.video_id for r in sources.raw_videos(spark, str(tmp_path)).collect()] == ["P1", "P10"]
    assert [r.video_id for r in sources.raw_videos(spark, str(tmp_path), "P1").collect()] == ["P1"]
    with pytest.raises(FileNotFoundError):
        sources.raw_videos(spark, str(tmp_path), "P")
    (tmp_path / "P1.avi").write_bytes(b"x")
    with pytest.raises(ValueError):
        sources.raw_videos(spark, str(tmp_path))
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            sources.check_video_id(bad)


def test_documents(spark, tmp_path):
    frames = {f"frames_fixed/{i}.jpg": {"timestamp_sec": 3.0 - i, "source_timestamp_sec": 3.0 - i, "sampling": "fixed"} for i in range(4)} | {f"frames_scene/{i}.jpg": {"timestamp_sec": 1.0} for i in range(5)}
    d = spark.createDataFrame([("v", json.dumps(frames))], "video_id string, j string")
    assert [(r.n, r.timestamp_sec) for r in sources.frame_map(d, "j", expected=4).orderBy("n").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)]
    with pytest.raises(Exception, match="frame count"):
        sources.frame_map(d, "j", expected=5).collect()
    p = tmp_path / "r.csv"
    p.write_bytes("﻿narration_id,video_id,narration\r\n1,v,\"a, b\"\r\n".encode())
    assert [(r.narration_id, r.narration) for r in sources.reference_csv(spark, str(p), ["video_id"]).collect()] == [("1", "a, b")]
    p.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        sources.reference_csv(spark, str(p), ["a"])
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"schema_version": 1, "dataset_id": "d", "dataset_version": "1", "purpose": "p", "records": [{"video_id": "v"}]}))
    assert [r.video_id for r in sources.manifest_records(spark, str(m)).collect()] == ["v"]
    m.write_text(json.dumps({"schema_version": 2}))
    with pytest.raises(ValueError):
        sources.manifest_records(spark, str(m))
    h = {r.path.rpartition("/")[2]: r.sha256 for r in sources.file_hashes(spark, str(tmp_path)).collect()}
    assert len(h["r.csv"]) == 64


def test_sinks(spark, tmp_path):
    t = str(tmp_path / "t")
    df = lambda xs: spark.createDataFrame(xs, "video_id string, n long")
    sinks.overwrite_videos(df([("a", 1), ("b", 1)]), t)
    sinks.overwrite_videos(df([("a", 2)]), t)
    rows = lambda: sorted((r.video_id, r.n) for r in spark.read.parquet(t).collect())
    assert rows() == [("a", 2), ("b", 1)]
    sinks.write_pending(df([("a", 9), ("c", 9)]), t)
    assert rows() == [("a", 2), ("b", 1), ("c", 9)]
    with pytest.raises(Exception, match="EXISTS"):
        sinks.write_new(df([]), t)
    for _ in range(2):
        sinks.append_journal(df([("a", 1)]), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert [r.video_id for r in sinks.blank_sidecars(df([("a", 1), ("d", 1)]), df([("a", 1)])).collect()] == ["d"]


def test_adapters(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    got = [r.e for r in df.select(adapters.embed(F.col("t"), 8).alias("e")).collect()]
    assert len(got[0]) == 8 and got[1] is None and sum(x * x for x in got[0]) == pytest.approx(1)
    w = spark.createDataFrame([("w", ["a", "b"], [0.0, 0.5]), ("x", ["a", "b"], [1.0, 1.0])], "window_id string, frame_ids array<string>, times array<double>")
    assert {r.window_id: (r.success, r.fps) for r in adapters.observe_windows(w).collect()} == {"w": (True, 2.0), "x": (False, None)}
    a = spark.createDataFrame([("v", bytearray(b"x" * 64000)), ("s", None)], "video_id string, content binary")
    assert {r.video_id: (r.source_type, r.end_sec) for r in adapters.transcribe(a).collect()} == {"v": ("model_transcript", 2.0), "s": ("no_audio_stream", None)}

    def broken(_):
        raise RuntimeError("no")

    f = spark.createDataFrame([("f", bytearray(b"x"))], "frame_id string, content binary")
    assert [(r.success, r.error) for r in adapters.caption_frames(f, broken).collect()] == [(False, "no")]


def test_pipeline_and_service(spark, tmp_path):
    caps = [(1, "v", "f1", 1.5, 1.5, "p", "a pan", True, "model", "m", "b", None, None), (2, "w", "f1", 8.25, 8.25, "p", "a cup", True, "model", "m", "b", None, None)]
    segs = [(1, "v", 0, 1.0, 2.0, "slice the lemon", 0.1, "model_transcript")]
    root = str(tmp_path)
    spark.createDataFrame(caps, CAP).write.parquet(f"{root}/captions")
    spark.createDataFrame(segs, SEG).write.parquet(f"{root}/segments")
    assert phase_range("3", "4") == ["3", "3.5", "4"]
    with pytest.raises(ValueError):
        phase_range("7", "5")
    c = load_config(None, {})
    p = Pipeline(spark, root, c)
    for _ in range(2):  # a second run replaces
        assert p.run("5", "7") == ["5", "6", "7"]
    assert spark.read.parquet(f"{root}/memory").count() == 2
    s = QuestionService(spark, f"{root}/memory")
    got = s.ask("lemon", video_id="v")
    assert got["status"] == "ok" and got["answer_status"] == "insufficient_evidence" and len(got["evidence_cards"]) == 1 and not got["evidence_cards"][0]["accepted_as_fact"]
    assert s.ask("lemon", start_sec=100, end_sec=200)["status"] == "no_matches"
    assert respond(QuestionService(spark, f"{root}/none"), "GET", "/ask", {"question": "x"})[0] == 503
    assert respond(s, "GET", "/ask", {"question": " "})[0] == 422 and respond(s, "GET", "/nowhere", {})[0] == 404
    assert respond(s, "GET", "/summary/zz", {})[0] == 404 and respond(s, "GET", "/summary/v", {})[1]["transcript_head"] == "slice the lemon"
    assert respond(s, "GET", "/videos", {})[1] == {"videos": ["v", "w"], "total": 2}
    assert respond(s, "GET", "/tasks", {"limit": "1"})[1] == {"tasks": [], "total": 0} and respond(s, "GET", "/topics", {"limit": "0"})[0] == 422
    assert respond(s, "POST", "/query", {"query": "lemon", "k": 1})[1]["total"] == 1
    for bad in (("", 5), ("q", 11), ("q", True), ("q", 5, 1.0), ("q", 5, 2.0, 1.0), ("q", 5, float("nan"), 1.0), ("x" * 1001, 5)):
        with pytest.raises(ValueError):
            checked_question(*bad)


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 1)], "video_id string, n long").coalesce(1).write.parquet(src)
    run = lambda: replace_stream(spark.readStream.schema("video_id string, n long").parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("a", 2)], "video_id string, n long").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted((r.video_id, r.n) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 1)]
    ticks = str(tmp_path / "ticks")
    spark.range(20).selectExpr("'v' video_id", "timestamp_seconds(id) ts", "id / 2.0D t").write.parquet(ticks)
    q = rate_limited_stream(spark.readStream.schema("video_id string, ts timestamp, t double").parquet(ticks), 2.0).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.t for r in spark.table("kept").collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_a_video_in_two_batches_keeps_all_its_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = lambda xs: spark.createDataFrame(xs, "video_id string, block string, seq long")
    stream = lambda: replace_stream(spark.readStream.schema("video_id string, block string, seq long").parquet(src), out, str(tmp_path / "cp"), keys=["block"], ordinal="seq").awaitTermination()
    df([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", None, 3)]).coalesce(1).write.parquet(src)
    stream()
    df([("a", "y", 5), ("a", "z", 6), ("a", "x", 0)]).coalesce(1).write.mode("append").parquet(src)
    stream()
    want = [("a", "x", 1), ("a", "y", 5), ("a", "z", 6), ("b", "x", 3), ("b", None, 3)]
    rows = lambda: sorted(((r.video_id, r.block, r.seq) for r in spark.read.parquet(out).collect()), key=str)
    assert rows() == want
    merge_rows(df([("a", "y", 5), ("a", "z", 6)]), out, ["block"], "seq")  # a batch that is run again
    assert rows() == want


def test_a_merged_table_has_files_by_bucket_and_not_by_video(spark, tmp_path):
    out, old = str(tmp_path / "out"), str(tmp_path / "old")
    df = lambda xs: spark.createDataFrame(xs, "video_id string, block string, seq long")
    first = df([(f"v{i}", b, 1) for i in range(600) for b in "xy"] + [(None, "x", 1)]).repartition(8)
    merge_rows(first, out, ["block"], "seq")
    files = lambda at: {f.relative_to(at) for f in Path(at).rglob("*.parquet")}
    before = files(out)
    assert len(before) < 300
    later = df([("v7", "x", 2), ("v7", "z", 2), ("v8", "y", 0), (None, "x", 3)])
    merge_rows(later, out, ["block"], "seq")
    assert len(before & files(out)) >= len(before) - 12  # buckets of other videos are not written again
    want = {(f"v{i}", b): 1 for i in range(600) for b in "xy"} | {("v7", "x"): 2, ("v7", "z"): 2, (None, "x"): 3}
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(want) and {(r.video_id, r.block): r.seq for r in rows} == want
    sinks.overwrite_videos(df([("a", "x", 1), ("b", "x", 1)]), old)  # a table by video keeps its layout
    merge_rows(df([("a", "x", 2), ("c", "x", 1)]), old, ["block"], "seq")
    assert sorted((r.video_id, r.seq) for r in spark.read.parquet(old).collect()) == [("a", 2), ("b", 1), ("c", 1)] and {p.name for p in Path(old).glob("video*")} == {"video_id=a", "video_id=b", "video_id=c"}


def test_pending_writes_fail_on_a_broken_table(spark, tmp_path):
    t = tmp_path / "t" / "video_id=a"
    t.mkdir(parents=True)
    (t / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        sinks.write_pending(spark.createDataFrame([("a", 1)], "video_id string, n long"), str(tmp_path / "t"))
    assert (t / "part-0.parquet").exists()


def test_csv_headers(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('video_id,"a, b"\nv,1\n')
    assert spark.sparkContext and sources.reference_csv(spark, str(p), ["a, b"]).first()["a, b"] == "1"
    d = tmp_path / "two"
    d.mkdir()
    (d / "1.csv").write_text("video_id,label\nv,x\n")
    (d / "2.csv").write_text("label,video_id\ny,w\n")
    with pytest.raises(Exception):
        sources.reference_csv(spark, str(d), ["label"]).collect()


def test_hashes_are_read_in_blocks(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 5000
    (tmp_path / "a b.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")  # Spark's reader lists no empty files
    got = {r.path.rpartition("/")[2].replace("%20", " "): (r.length, r.sha256) for r in sources.file_hashes(spark, str(tmp_path), 4096).collect()}
    assert got == {"a b.bin": (len(data), hashlib.sha256(data).hexdigest())}


def test_registered_queries_beside_sql(spark):
    import os

    import __spark_entry__ as e
    from tests.compare import duck, same
    from tidemark.plans import core_queries, core_sql

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con, qs = duck(folder), core_queries()
    assert set(core_sql()) <= set(qs) and set(e.oracle_sql()) <= set(e.queries())
    for name in ("p4_found", "knn_topk", "topic_counts", "align_range_join", "manifest_violations", "reference_clip_rebase", "evidence_cards", "keyed_replace"):
        assert same(qs[name](spark, folder), con, core_sql()[name])[0] == "", name
    assert e.entry(spark).count() == 10


def test_quality_phase(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    grey = lambda x: bytearray(b"P5 64 64 255\n" + x.astype(np.uint8).tobytes())
    a, b = rng.integers(60, 200, (64, 64)), rng.integers(60, 200, (64, 64))
    images = [a, a, b, np.full((64, 64), 128), rng.integers(0, 60, (64, 64)), rng.integers(0, 60, (64, 64))]
    rows = [("v", i, f"v/{i}.pgm", grey(x)) for i, x in enumerate(images)] + [("v", 6, "v/6.pgm", bytearray(b"?")), ("w", 7, "w/7.pgm", grey(a))]
    spark.createDataFrame(rows, "video_id string, frame_no long, path string, content binary").write.parquet(f"{tmp_path}/frames")
    spark.createDataFrame([("v",)], "video_id string").write.parquet(f"{tmp_path}/captions")
    assert Pipeline(spark, str(tmp_path), load_config(None, {})).run("3", "4") == ["3.5"]
    got = {r.frame_no: (r.verdict, r.duplicate_of) for r in spark.read.parquet(f"{tmp_path}/quality").collect()}
    assert got == {0: ("usable", None), 1: ("duplicate", 0), 2: ("usable", None), 3: ("blurry", None), 4: ("dark", None), 5: ("dark", None), 6: ("unreadable", None), 7: ("usable", None)}
