"""The dataset command line, caption stores, decoded images, legacy metadata, and small provenance rules."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import datasets, service, sources
from tidemark.operators import provenance as V
from tidemark.operators import quality as Q
from tidemark.sources.sinks import VideoStore


def record(**more):
    return {"video_id": "P01", "split": "train", "source_url": "https://host/x", "license_id": "cc", "source_duration_seconds": 10.0, "clip_interval_seconds": [0.0, 10.0], "timestamp_unit": "seconds", "timestamp_origin": "source_video_start", "size_bytes": None, "sha256": None, "verification_status": "pending", "reference_annotations": [{"kind": "action"}]} | more


def manifest(path, *records):
    path.write_text(json.dumps({"schema_version": 1, "dataset_id": "d", "dataset_version": "1", "purpose": "p", "records": list(records)}))
    return str(path)


def test_dataset_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    m, clip, new = manifest(tmp_path / "m.json", record()), tmp_path / "clip.mp4", str(tmp_path / "new.json")
    clip.write_bytes(b"video" * 1000)
    run = lambda *a: datasets.main(list(a), spark, lambda _: 10.0)
    assert run("validate", "--manifest", m) == 0 and json.loads(capsys.readouterr().out)["records"] == 1
    assert run("validate", "--manifest", manifest(tmp_path / "bad.json", record(split=""))) == 2
    prepare = ("prepare", "--manifest", m, "--video", "P01", "--source", str(clip), "--raw-dir", str(tmp_path / "raw"), "--output-manifest", new)
    assert run(*prepare) == 2
    assert run(*prepare, "--acknowledge-license") == 0 and (tmp_path / "raw" / "P01.MP4").read_bytes() == clip.read_bytes()
    assert run(*prepare, "--acknowledge-license") == 2  # nothing is replaced
    assert run("verify", "--manifest", new, "--video", "P01", "--source", str(clip)) == 0
    clip.write_bytes(b"other")
    assert run("verify", "--manifest", new, "--video", "P01", "--source", str(clip)) == 2 and run("verify", "--manifest", m, "--video", "none", "--source", str(clip)) == 2
    refs = tmp_path / "r.csv"
    refs.write_text('narration_id,video_id,start_timestamp,stop_timestamp,narration\n1,P01,00:00:01.25,00:00:03.5,"open, close"\n2,P02,00:00:00,00:00:09,x\n')
    ask = ("references", "--manifest", m, "--video", "P01", "--csv", str(refs), "--kind")
    assert run(*ask, "action", "--output", str(tmp_path / "labels.json")) == 0
    got = json.loads((tmp_path / "labels.json").read_text())["annotations"]
    assert [(a["annotation_id"], a["clip_start"], a["clip_end"], a["label"]) for a in got] == [("1", 1.25, 3.5, "open, close")]
    assert run(*ask, "sound", "--output", str(tmp_path / "s.json")) == 2
    assert run(*ask, "action", "--output", str(tmp_path / "data" / "raw" / "labels.json")) == 2


def test_caption_store(spark, tmp_path, capsys):
    doc = {"video_id": "v", "captions": [{"frame_id": "f1", "timestamp_sec": 1.0, "caption": " a pan ", "source_type": "model", "model": "m"}, {"frame_id": "f2", "timestamp_sec": 9.0, "source_timestamp_sec": 2.0, "caption": "a cup", "source_type": "model"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc))
    store = str(tmp_path / "store")
    run = lambda *a: (service.main([store, "--dims", "16", *a], spark), json.loads(capsys.readouterr().out))
    for _ in range(2):
        assert run("visual-index", str(path)) == (0, {"indexed": 2})
    code, body = run("visual-search", "a pan", "--limit", "1")
    assert code == 0 and [(r["observation"], r["frame_timestamp_sec"], r["verification_status"]) for r in body["results"]] == [("a pan", 1.0, "unvalidated_model_hypothesis")]
    for wrong in ({"caption": " "}, {"source_type": "human"}, {"timestamp_sec": None}):
        path.write_text(json.dumps(doc | {"captions": [doc["captions"][0] | wrong]}))
        assert run("visual-index", str(path))[0] == 1
    assert VideoStore(spark, store, 16).load().count() == 2
    path.write_text(json.dumps(doc | {"captions": []}))
    assert run("visual-index", str(path)) == (0, {"indexed": 0}) and VideoStore(spark, store, 16).load().count() == 0


def png(x):
    h, w, _ = x.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + x[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoded_images(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(b"no image")
    images = sources.decoded_images(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r for r in Q.pixel_statistics(images).collect()}
    luma = x.astype(float) @ np.array([0.299, 0.587, 0.114])
    assert got["a.png"].luma == pytest.approx(luma.mean()) and len(got["a.png"].phash) == 64 and got["b.png"].luma is None
    small = {r.path.rpartition("/")[2]: r for r in Q.normalised_images(images, short=10).collect()}
    a = np.frombuffer(bytes(small["a.png"].pixels), np.uint8).reshape(small["a.png"].height, small["a.png"].width, 3)
    assert a.shape == (10, 15, 3) and np.abs(a - x.reshape(10, 2, 15, 2, 3).mean((1, 3))).max() <= 1 and small["b.png"].pixels is None
    assert {(r.height, r.width) for r in Q.normalised_images(images, square=8).where("pixels IS NOT NULL").collect()} == {(8, 8)}


def test_legacy_metadata(spark, tmp_path):
    rows = [{"video_id": "v", "block_id": f"ctx_{i:04d}", "time_range": [0.0, 1.0], "topics": ["a"], "intent": "Informational", "confidence": 0.9} for i in range(3)]
    p = tmp_path / "metadata.json"
    p.write_text(json.dumps(rows, indent=1))
    got = sources.legacy_memory(spark, str(p)).orderBy("memory_id").collect()
    assert [(r.memory_id, r.block_id, r.accepted_as_fact, r.model_confidence_unvalidated) for r in got] == [(i, f"ctx_{i:04d}", None, 0.9) for i in range(3)]


def test_traces_and_arms(spark):
    f = spark.createDataFrame([("a", i, t, f"h{i}", 3, 4.0) for i, t in enumerate([0.0, 1.5, 3.0])] + [("b", 0, 0.0, None, 2, 0.0)], "k string, o int, t double, hash string, n int, s double")
    got = {r.k: r for r in V.decode_trace(f, "k", "o", F.col("n"), F.col("s")).collect()}
    assert list(got["a"].source_times) == [4.0, 5.5, 7.0] and list(got["a"].hashes) == ["h0", "h1", "h2"] and got["a"].error is None
    assert got["b"].error == "frame count differs" and list(got["b"].hashes) == []
    settings = spark.createDataFrame([({"fps": "2.0", "other": "x"},)], "m map<string,string>").select(V.preprocessor_contract(F.col("m")).alias("c")).first().c
    assert settings.fps == "2.0" and settings.patch_size is None and len(settings) == 14
    refs = spark.createDataFrame([([{"kind": "sound", "role": "x"}, {"kind": "action", "role": "y"}],), ([],), (None,)], "r array<struct<kind:string,role:string>>")
    assert [x.r.role if x.r else None for x in refs.select(V.reference_of_kind(F.col("r"), F.lit("action")).alias("r")).collect()] == ["y", None, None]
    with pytest.raises(ValueError):
        V.select_windows(f, "anchored")
