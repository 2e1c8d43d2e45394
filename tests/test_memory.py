"""Vector memory: the literal fixtures, and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import memory as M
from tidemark.sources.sinks import VideoStore, check_label_destination, write_new_json

SCHEMA = "ordinal long, video_id string, block_id string, time_range array<double>, embedding array<float>"


def rows(spark, xs):
    return spark.createDataFrame([(i, v, f"ctx_{i:04d}", t, e) for i, (v, t, e) in enumerate(xs)], SCHEMA)


def test_filter_comes_before_k(spark):
    m = rows(spark, [("other", [0.0, 1.0], [0.0, 0.0])] * 100 + [("target", [0.0, 1.0], [10.0, 0.0]), ("target", [1.0, 2.0], [12.0, 0.0]), ("target", [2.0, 3.0], [11.0, 0.0])])
    ask = lambda k: [r.block_id for r in M.search(m, [0.0, 0.0], k, key="video_id", key_value="target").collect()]
    assert ask(2) == ["ctx_0100", "ctx_0102"] and len(ask(20)) == 3 and ask(0) == []


def test_closed_time_overlap(spark):
    m = rows(spark, [("a", [0.0, 1.0], [0.0, 0.0]), ("a", [4.0, 5.0], [4.0, 0.0]), ("a", [3.0, 6.0], [2.0, 0.0]), ("a", None, [0.0, 0.0]), ("a", [9.0, 7.0], [0.0, 0.0])])
    got = M.search(m, [0.0, 0.0], 9, time_range=(5.0, 10.0)).collect()
    assert [(r.ordinal, r.distance) for r in got] == [(2, 4.0), (1, 16.0)] and got[0].similarity == pytest.approx(0.2)


def test_bad_vectors_never_match(spark):
    m = rows(spark, [("a", None, [1.0, float("nan")]), ("a", None, [1.0]), ("a", None, None), ("a", None, [float("inf"), 0.0]), ("a", None, [1.0, 1.0])])
    assert [r.ordinal for r in M.search(m, [0.0, 0.0], 5).collect()] == [4]
    assert {r.ordinal: r.errors for r in M.batch_errors(m, "embedding", 2, "video_id").collect()} == {0: ["not finite"], 1: ["wrong dimension"], 2: ["wrong dimension"], 3: ["not finite"]}


def test_search_all_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[3]
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "id long, e array<float>")
    got = M.search_all(df, df.where("id % 10 = 0"), "id", "e", 4, 8).collect()
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    for q in range(0, 300, 10):
        want = sorted((d[q, j], j) for j in range(300) if j != q)[:4]
        mine = sorted((r.distance, r.id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == [i for _, i in want] and [d for d, _ in mine] == pytest.approx([d for d, _ in want])
    assert M.search_all(df.limit(0), df.limit(0), "id", "e", 4, 8).collect() == []


def test_store_replace(spark, tmp_path):
    s = VideoStore(spark, str(tmp_path / "s"), 2)
    with pytest.raises(FileNotFoundError):
        s.load()
    s.add(rows(spark, [("b", [0.0, 1.0], [20.0, 20.0])]))
    a = rows(spark, [("a", [float(i), i + 1.0], [i + 1.0, 0.0]) for i in range(3)])
    for _ in range(3):
        s.replace_video("a", a)
    assert s.load().count() == 4
    for bad in ([("a", None, [1.0, 2.0, 3.0])], [("a", None, [float("nan"), 1.0])], [("b", None, [1.0, 1.0])]):
        with pytest.raises(ValueError):
            s.replace_video("a", rows(spark, bad))
    assert s.load().count() == 4
    s.replace_video("a", rows(spark, [("a", None, [9.0, 9.0])]))
    assert sorted(r.video_id for r in s.load().collect()) == ["a", "b"]
    s.replace_video("a", rows(spark, []))
    assert [r.video_id for r in s.load().collect()] == ["b"]
    for dims in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            VideoStore(spark, "x", dims)


def test_store_adds_without_writing_again(spark, tmp_path):
    s = VideoStore(spark, str(tmp_path / "s"), 2)
    s.add(rows(spark, []))
    assert s.load().count() == 0
    for i in range(3):
        s.add(rows(spark, [("a", [0.0, 1.0], [float(i), 0.0])]))
    s.replace_video("a", rows(spark, [("a", None, [7.0, 7.0])]))
    s.add(rows(spark, [("a", None, [8.0, 8.0]), ("c", None, [1.0, 1.0])]))
    vectors = lambda: sorted((r.video_id, list(r.embedding)) for r in s.load().collect())
    want = [("a", [7.0, 7.0]), ("a", [8.0, 8.0]), ("c", [1.0, 1.0])]
    assert vectors() == want and s.current() == 5
    s.compact()
    assert vectors() == want and s.load().columns == rows(spark, []).columns or set(s.load().columns) == set(rows(spark, []).columns)


def test_rollups(spark):
    df = spark.createDataFrame(
        [(1, "v", "b1", [0.0, 1.0], True, ["x", "y"], ["d1"], ["t1", "t2"], "hello"), (2, "v", "b2", None, True, ["y", "z", "x"], [], None, ""), (3, "v", "b3", None, False, ["q"], ["no"], ["no"], "world"), (4, "w", "b4", None, None, None, None, None, None)],
        "memory_id long, video_id string, block_id string, time_range array<double>, accepted_as_fact boolean, topics array<string>, decisions array<string>, tasks array<string>, speech_text string",
    )
    assert [(r["topic"], r["count"]) for r in M.top_topics(df).collect()] == [("x", 2), ("y", 2), ("z", 1)]
    assert [r.task for r in M.accepted_items(df, "tasks", "task").orderBy("memory_id", "position").collect()] == ["t1", "t2"]
    got = {r.video_id: r.asDict() for r in M.video_summaries(df).collect()}
    assert got["v"] == {"video_id": "v", "topics": ["x", "y", "z"], "decisions": 1, "tasks": 2, "unvalidated_blocks": 1, "blocks": 3, "transcript_head": "hello world"}
    assert got["w"]["transcript_head"] == "" and got["w"]["blocks"] == 1
    assert M.list_events(df, 0).count() == 0


def test_acceptance_split_and_text(spark):
    df = spark.createDataFrame([("accepted_independent_evidence", True, ["a"], ["d"], None), ("accepted_independent_evidence", None, ["a"], ["d"], ["t"]), ("x", True, None, None, None)], "verification_status string, accepted_as_fact boolean, topics array<string>, decisions array<string>, tasks array<string>")
    got = M.split_by_acceptance(df).collect()
    assert [r.accepted_as_fact for r in got] == [True, False, False]
    assert got[0].topics == ["a"] and got[0].unvalidated_topics == [] and got[1].topics == [] and got[1].unvalidated_tasks == ["t"]
    text = lambda ok: M.searchable_text(F.lit("s"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("e")), F.array(F.lit("d")), F.array().cast("array<string>"), F.lit(ok))
    r = df.limit(1).select(text(True), text(False), M.searchable_text(F.lit(""), *[F.array().cast("array<string>")] * 4, F.lit(False))).first()
    assert tuple(r) == ("s | Topics: a, b | Entities: e | Decisions: d", "UNVALIDATED MODEL HYPOTHESIS | s | Topics: a, b | Entities: e", "")


def test_firewall_and_exclusive_write(tmp_path):
    root = tmp_path / "processed"
    root.mkdir()
    (tmp_path / "link").symlink_to(root)
    for bad in (root / "x.json", tmp_path, tmp_path / "link" / "y", tmp_path / "out" / "transcript.json"):
        with pytest.raises(ValueError):
            check_label_destination(str(bad), [str(root)])
    good = check_label_destination(str(tmp_path / "labels" / "x.json"), [str(root)])
    good.parent.mkdir()
    write_new_json(str(good), {"a": 1})
    with pytest.raises(FileExistsError):
        write_new_json(str(good), {})
