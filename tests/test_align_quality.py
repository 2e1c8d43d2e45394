"""Alignment and quality against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import align as A
from tidemark.operators import quality as Q

CAP = "caption_id long, video_id string, frame_id string, timestamp_sec double, source_timestamp_sec double, source_path string, caption string, success boolean, source_type string, model string, backend string, device string, frame_hash string"
SEG = "segment_id long, video_id string, id long, start_sec double, end_sec double, text string, no_speech_prob double, source_type string"


def test_anchors_and_limiter_against_python(spark):
    r = random.Random(5)
    caps = [(i, r.choice(["hot", "hot", "b"]), r.choice([round(r.uniform(0, 60), 2), 7.0, None, float("nan")])) for i in range(200)]
    segs = [(i, r.choice(["hot", "b"]), a, a + r.uniform(0, 3)) for i, a in enumerate(r.uniform(0, 60) for _ in range(6))]
    f = spark.createDataFrame([(i, v, None if t is None else float(t), None) for i, v, t in caps], "caption_id long, video_id string, timestamp_sec double, success boolean")
    s = spark.createDataFrame([(i, v, a, b) for i, v, a, b in segs], "segment_id long, video_id string, start_sec double, end_sec double")
    usable = [(i, v, t) for i, v, t in caps if t is not None and t == t]
    want = set()
    for v in ("hot", "b"):
        kept = []
        for i, w, t in usable:
            if w == v and not any(x == v and a - 2 <= t <= b + 2 for _, x, a, b in segs) and not any(t >= k - 2 and t <= k + 2 for k in kept):
                kept.append(t)
                want.add((v, i, t))
    assert {tuple(x) for x in A.visual_anchors(A.usable_frames(f), s, 2.0).collect()} == want
    want = set()
    for v in ("hot", "b"):
        last = None
        for t, i in sorted((t, i) for i, w, t in usable if w == v):
            if last is None or t - last >= 1.5:
                want.add((v, i, t))
                last = t
    assert {tuple(x) for x in A.rate_limited(A.usable_frames(f), 1.5).collect()} == want


def test_blocks(spark):
    caps = [(1, "v", "f1", 8.25, 8.25, "p", "a pan", True, "model", "m", "b", None, "h"), (2, "v", "f2", 1.0, None, "p", "a cup", None, "model", "m", "b", "cpu", None), (3, "v", "f3", 1.5, 1.5, "p", "a cup", True, "model", None, "b", None, None), (4, "v", "f4", 1.6, 1.6, "p", None, False, "model", "m", "b", None, None)]
    segs = [(1, "v", 0, 1.25, 2.75, " hi ", 0.03, None), (2, "v", 1, 50.0, 51.0, None, None, "x"), (3, "v", 2, float("nan"), 1.0, "bad", 0.0, "x")]
    got = A.context_blocks(spark.createDataFrame(segs, SEG), spark.createDataFrame(caps, CAP)).orderBy("block_id").collect()
    assert [(r.block_id, r.start_sec, r.speech, r.caption, r.frame_count, r.visual_status, r.source_type) for r in got] == [
        ("ctx_0000", 1.25, "hi", "a cup", 2, "unvalidated_model_hypothesis", "model_transcript"),
        ("ctx_0001", 8.25, "", "a pan", 1, "unvalidated_model_hypothesis", "visual_only"),
        ("ctx_0002", 50.0, "", "", 0, "no_visual_observation", "x"),
    ]
    o = got[0].observations
    assert len(o) == 1 and o[0].model_provenance == {"model": "m", "backend": "b", "device": "cpu"} and o[0].source_pts_sec == [1.0]
    empty = A.context_blocks(spark.createDataFrame([], SEG), spark.createDataFrame(caps[:1], CAP)).collect()
    assert [(r.start_sec, r.end_sec, r.source_type) for r in empty] == [(8.25, 8.25, "visual_only")]
    assert A.context_blocks(spark.createDataFrame([], SEG), spark.createDataFrame([], CAP)).count() == 0


def test_leaders_against_python(spark):
    r = random.Random(6)
    base = [r.getrandbits(256) for _ in range(6)]

    def noisy():
        h = r.choice(base)
        for _ in range(r.randint(0, 5)):
            h ^= 1 << r.randrange(256)
        return f"{h:064x}"

    rows = [(i, r.choice(["hot", "hot", "b"]), noisy() if r.random() < 0.9 else r.choice([None, "zz", ""])) for i in range(150)]
    rows += [(150 + i, "b", rows[i][2]) for i in range(20)]
    got = {x.i: x.duplicate_of for x in Q.leader_dedup(spark.createDataFrame(rows, "i long, v string, h string"), "v", "i", "h").collect()}
    kept = {"hot": [], "b": []}
    for i, v, h in rows:
        want = None
        if h and len(h) == 64:
            want = next((k for k, x in kept[v] if bin(int(x, 16) ^ int(h, 16)).count("1") <= 6), None)
            if want is None:
                kept[v].append((i, h))
        assert got[i] == want, i
    assert Q.leader_dedup(spark.createDataFrame([], "i long, v string, h string"), "v", "i", "h").count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([(None, 1.0), (59.9, 100.0), (60.0, 39.9), (60.0, 215.1), (60.0, 215.0), (float("nan"), 1.0)], "s double, l double")
    assert [r[0] for r in df.select(Q.verdict(F.col("s"), F.col("l"))).collect()] == ["unreadable", "blurry", "dark", "bright", None, "unreadable"]


def test_images(spark, tmp_path):
    flat, grad = np.full((40, 60), 7, np.uint8), np.tile(np.arange(60, dtype=np.uint8) * 4, (40, 1))
    chess = (np.indices((40, 60)).sum(0) % 2 * 255).astype(np.uint8)
    files = {n: b"P5\n60 40\n255\n" + x.tobytes() for n, x in (("flat", flat), ("grad", grad), ("chess", chess))} | {"broken": b"P5 60", "empty": b""}
    got = {r.path: r for r in Q.image_statistics(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")).collect()}
    assert got["flat"].luma == 7 and got["flat"].sharpness == 0 and got["chess"].sharpness > 1e5 and got["broken"].luma is None and got["empty"].phash is None
    assert abs(got["grad"].luma - grad.mean()) < 1e-9 and len(got["grad"].phash) == 64 and len(got["grad"].reduced_luma) == 64 * 36
    d = spark.createDataFrame([(got["flat"].reduced_luma, got["grad"].reduced_luma)], "a array<int>, b array<int>").select(Q.mean_luma_delta(F.col("a"), F.col("b"))).first()[0]
    assert 100 < d < 120


def test_rate_limiter_over_one_continuous_video(spark):
    """A third of all frames are one video without a pause, so that chunks are entered in the middle of it."""
    import random

    from tidemark.operators.align import rate_limited

    r = random.Random(7)
    rows = [("long", round(i * 0.37 + r.random() * 0.3, 3), i) for i in range(900)] + [(f"v{i % 40}", round(r.random() * 60, 3), 1000 + i) for i in range(1500)] + [(None, float(i), 4000 + i) for i in range(30)]
    rows += [("long", t, 9000 + i) for i, (_, t, _) in enumerate(rows[:50])]
    df = spark.createDataFrame(rows, "video_id string, timestamp_sec double, caption_id long").withColumn("k", F.lit("x"))
    for step in (0.1, 5.0, 200.0):
        want = set()
        for v in {x[0] for x in rows}:
            last = None
            for _, t, i in sorted((x for x in rows if x[0] == v), key=lambda x: (x[1], x[2])):
                if last is None or t - last >= step:
                    want.add((v, t, i))
                    last = t
        got = {(x.video_id, x.timestamp_sec, x.caption_id) for x in rate_limited(df, step).collect()}
        assert got == want, step
    assert rate_limited(df.limit(0), 1.0).count() == 0


def test_anchors_against_the_plain_rule(spark):
    import random

    from tidemark.operators.align import visual_anchors

    r = random.Random(8)
    frames = [(r.choice(["a", "b"]), round(r.random() * 200, 1), i) for i in range(600)]
    segments = [("a", 50.0, 60.0), ("b", 10.0, 10.0)]
    want = set()
    for v in "ab":
        kept = []
        for _, t, i in sorted((x for x in frames if x[0] == v), key=lambda x: x[2]):
            if not any(s - 2.0 <= t <= e + 2.0 for w, s, e in segments if w == v) and not any(a - 2.0 <= t <= a + 2.0 for a in kept):
                kept.append(t)
                want.add((v, i))
    F_ = spark.createDataFrame(frames, "video_id string, timestamp_sec double, caption_id long")
    S = spark.createDataFrame(segments, "video_id string, start_sec double, end_sec double")
    assert {(x.video_id, x.caption_id) for x in visual_anchors(F_, S, 2.0).collect()} == want


def test_near_hashes_share_a_pair_of_bands():
    import random

    from tidemark.operators.quality import _BANDS, _PAIRS, SAME_BITS

    r = random.Random(3)
    assert sum(n for _, n in _BANDS) == 64 and len(_PAIRS) == 12
    cut = lambda h, i: h[_BANDS[i][0] - 1 : _BANDS[i][0] - 1 + _BANDS[i][1]]
    for _ in range(2000):
        x = r.getrandbits(256)
        y = x
        for b in r.sample(range(256), SAME_BITS):
            y ^= 1 << b
        g, h = f"{x:064x}", f"{y:064x}"
        assert any(cut(g, a) == cut(h, a) and cut(g, b) == cut(h, b) for a, b in _PAIRS)
