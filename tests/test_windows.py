"""Window selection: the literal fixtures and a plain greedy beside random frames."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows as W


def frames(spark, per_key):
    rows = [(k, i + 1000 * n, float(t), None if d is None else float(d)) for n, (k, xs) in enumerate(per_key.items()) for i, (t, d) in enumerate(xs)]
    return spark.createDataFrame(rows, "k string, id long, t double, delta double")


def plain(xs, size, most, budget, novelty, anchors=None):
    n = len(xs)
    cands = [(round(sum(d for _, d in xs[s + 1 : s + size]) / (size - 1), 6), s) for s in range(n - size + 1)]
    chosen, used, why = [], set(), {}
    if anchors:
        last = n - size
        c = min(anchors, budget // size, last + 1)
        for s in dict.fromkeys([0] if c == 1 else [round(i * last / (c - 1)) for i in range(c)]):
            chosen.append(s)
            used |= set(range(s, s + size))
            why[s] = "anchor"
    for m, s in sorted(cands, key=lambda x: (-x[0], x[1])):
        if s in why:
            continue
        new = set(range(s, s + size)) - used
        if len(chosen) >= most:
            why[s] = "windows"
        elif (chosen or anchors) and len(new) < novelty:
            why[s] = "novelty"
        elif len(used) + len(new) > budget:
            why[s] = "frames"
        else:
            why[s] = "selected"
            chosen.append(s)
            used |= new
    return why


def test_luma_fixture(spark):
    luma = [0, 0, 255, 255, 8, 8]
    f = spark.createDataFrame([("v", i, float(i), float(x)) for i, x in enumerate(luma)], "k string, id long, t double, v double")
    d = W.frame_deltas(f, "v")
    assert [r.delta for r in d.orderBy("t").collect()] == [None, 0.0, 255.0, 0.0, 247.0, 0.0]
    got = W.select_by_change(d, 3, 1, 3).collect()
    assert len(got) == 4 and [(r.start, list(r.ids)) for r in got if r.selected] == [(0, [0, 1, 2])]


def test_novelty_and_anchor_fixtures(spark):
    f = frames(spark, {"v": [(i, 100 - i) for i in range(7)]})
    got = {r.start: r for r in W.select_by_change(f, 4, 2, 8, 2).collect()}
    assert sorted(s for s, r in got.items() if r.selected) == [0, 2] and got[1].reason == W.CHANGE_REASONS["novelty"]
    f = frames(spark, {"v": [(i, 100 - i) for i in range(16)]})
    got = W.select_anchored(f, 4, 3, 12, 2).collect()
    kinds = {r.start: r.kind for r in got if r.selected}
    assert [s for s, k in kinds.items() if k == "required_uniform_anchor"] == [0, 12] and sum(k == "motion_fill" for k in kinds.values()) == 1
    assert len({i for r in got if r.selected for i in r.ids}) == 10


def test_random_selection_and_reasons(spark):
    r = random.Random(4)
    per = {f"k{i}": [(t, r.choice([0, 1, 2, 5, 9])) for t in range(r.randint(1, 30))] for i in range(12)}
    f = frames(spark, per)
    for size, most, budget, novelty in ((3, 3, 9, 2), (4, 3, 12, None), (2, 4, 5, 1)):
        nov = novelty or max(1, size // 2)
        got = W.select_by_change(f, size, most, budget, novelty).collect()
        names = {v: k for k, v in W.CHANGE_REASONS.items()}
        for k, xs in per.items():
            assert {x.start: names[x.reason] for x in got if x.k == k} == (plain(xs, size, most, budget, nov) if len(xs) >= size else {})
            assert all(x.selected == (names[x.reason] == "selected") for x in got if x.k == k)
        got = W.select_anchored(f, size, most, budget, 2, novelty).collect()
        names = {v: k for k, v in W.ANCHORED_REASONS.items()}
        for k, xs in per.items():
            assert {x.start: names[x.reason] for x in got if x.k == k} == (plain(xs, size, most, budget, nov, 2) if len(xs) >= size else {})


def test_parameters():
    for bad in ((1, 1, 4), (True, 1, 4), (4, 0, 12), (4, 3, 3), (4.0, 3, 12)):
        with pytest.raises(ValueError):
            W.check_budget(*bad)
    with pytest.raises(ValueError):
        W.check_budget(4, 3, 12, 5)
    with pytest.raises(ValueError):
        W.check_budget(4, 3, 12, None, 4)


def test_coverage_fixture(spark):
    f = frames(spark, {"v": [(i, 10 - i) for i in range(8)]})
    refs = spark.createDataFrame([("v", "r", 5.1, 5.9), ("w", "x", 0.0, 1.0), ("v", "out", 7.0, 9.0)], "k string, ref string, r0 double, r1 double")
    spans = spark.createDataFrame([("v", 0.0, 7.0)], "k string, s0 double, s1 double")
    c = W.coverage(refs, spans, W.select_by_change(f, 3, 1, 3), W.select_uniform(f, 3, 1, 3))
    assert {r.ref: r.in_span for r in c.collect()} == {"r": True, "x": False, "out": False}
    assert [tuple(r)[1:] for r in W.coverage_summary(c).collect()] == [(1, 1, 1, 0, 0)]


def test_empty_and_errors(spark):
    e = frames(spark, {}) if False else spark.createDataFrame([], "k string, id long, t double, delta double")
    assert W.select_by_change(e).count() == 0 and W.select_uniform(e).count() == 0 and W.select_anchored(e).count() == 0
    f = spark.createDataFrame([("v", 1, 0.0), ("v", 1, 1.0), ("v", 2, 1.0), ("v", 3, float("nan"))], "k string, id long, t double")
    assert {(r.id, r.error) for r in W.frame_errors(f).collect()} == {(3, "time is not finite"), (1, "frame id repeated"), (1, "times do not increase")}


def test_trace_columns(spark):
    df = spark.createDataFrame([([0.0, 1.1678, 2.3357, 3.5035], 4.004, [2, 78, 138]), ([0.0, 0.0], 1.0, [2, 3, 3]), ([0.0], -1.0, [1, 1])], "t array<double>, s double, g array<int>")
    got = df.select(W.source_times(F.col("t"), F.col("s")).alias("m"), W.visual_tokens(F.col("g")).alias("n")).collect()
    assert got[0].m == pytest.approx([4.004, 5.1718, 6.3397, 7.5075]) and got[0].n == 5382
    assert got[1].m is None and got[1].n is None and got[2].m is None and got[2].n is None


def test_controls(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.0, 1.0, 2.0])], "ids array<string>, times array<double>")
    got = {r.input_order: (r.frame_ids, r.presentation_times) for r in W.presentation_controls(df).collect()}
    assert got["source_reverse"] == (["c", "b", "a"], [2.0, 1.0, 0.0]) and got["same_source_frame_repeated"] == (["a"] * 3, [0.0] * 3)


def test_greedy_with_tight_budgets(spark):
    """Budgets under which only windows that overlap taken ones still fit, far down the ranks."""
    r = random.Random(21)
    per_key = {f"k{i}": [(t, None if t == 0 else r.randint(0, 40)) for t in range(r.randint(4, 70))] for i in range(12)}
    f = frames(spark, per_key).cache()
    for size, most, budget, novelty in ((4, 3, 9, 1), (4, 5, 11, 1), (3, 4, 7, 2), (5, 3, 12, 2), (4, 3, 12, 2)):
        got = {(x.k, x.start): x.reason for x in W.select_by_change(f, size, most, budget, novelty).collect()}
        names = {v: k for k, v in W.CHANGE_REASONS.items()}
        want = {(k, s): why for k, xs in per_key.items() for s, why in plain([(t, d or 0) for t, d in xs], size, most, budget, novelty).items()}
        assert {k: names[v] for k, v in got.items()} == want, (size, most, budget, novelty)


def test_scratch_is_deleted(spark):
    import os

    from tidemark.session import cut, scratch, shared_folder, written

    before = shared_folder(spark)
    with scratch(spark) as folder:
        assert written(cut(spark.range(5).toDF("i"))).count() == 5
        path = folder.removeprefix("file:")
        assert os.listdir(path)
    assert not os.path.exists(path) and shared_folder(spark).rsplit("/", 1)[0] == before or os.path.exists(before.removeprefix("file:"))
