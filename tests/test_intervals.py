"""The sweep and the chunked scans against brute force."""

import random

from pyspark.sql import functions as F

from tidemark.operators.intervals import merge_intervals
from tidemark.operators.numbering import islands, numbered, row_chunks, row_windows
from tidemark.operators.ordered import chunked, previous_row, running_sums


def brute(rows):
    out = set()
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and s <= e:
            by.setdefault(k, []).append((s, e))
    for k, xs in by.items():
        merged = []
        for s, e in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged} | {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "k string, s long, e long")
    if extra:
        df = df.withColumns({"t": F.lit("x"), "d": F.lit(1), "n": F.lit(2), "up": F.lit(3), "__chunk": F.lit(9)})
    return {tuple(r) for r in merge_intervals(df, "k", "s", "e").collect()}


def test_small_cases(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a", 5, 5)]) == {("a", "period", 5, 5)}
    assert found(spark, [("a", 0, 5), ("a", 5, 9)]) == {("a", "period", 0, 9)}
    assert found(spark, [("a", 0, 9), ("a", 2, 3), ("a", 0, 9), ("a", 12, 12)]) == {("a", "period", 0, 9), ("a", "gap", 9, 12), ("a", "period", 12, 12)}
    assert found(spark, [(None, 0, 1), (None, 3, 4), ("a", None, 4), ("a", 4, 1)]) == brute([(None, 0, 1), (None, 3, 4)])


def test_random_with_a_hot_key_and_clashing_names(spark):
    r = random.Random(2)
    rows = []
    for _ in range(1500):
        s = r.randint(0, 4000)
        rows.append((r.choice(["hot"] * 4 + ["a", "b", None]), s, s + r.choice([0, 1, 2, 5, -1])))
    assert found(spark, rows, extra=True) == brute(rows)


def test_scans_do_not_depend_on_partitioning(spark):
    r = random.Random(3)
    rows = [(r.choice("aab"), r.randint(0, 50), i, r.randint(0, 3)) for i in range(400)]
    order = sorted(rows, key=lambda x: (x[0], x[1], x[2]))
    for parts in (1, 3, 17):
        c = chunked(spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(5), ["k", "t", "i"], parts)
        got = sorted(running_sums(c, ["k", "t", "i"], {"s": "v"}).collect(), key=lambda x: (x.k, x.t, x.i))
        total, want = 0, []
        for x in order:
            total += x[3]
            want.append(total)
        assert [x.s for x in got] == want
        got = sorted(previous_row(c, ["k", "t", "i"], ["i"]).collect(), key=lambda x: (x.k, x.t, x.i))
        assert [x.prev.i if x.prev else None for x in got] == [None, *[x[2] for x in order[:-1]]]


def test_numbering_windows_chunks(spark):
    rows = [("hot", i * 7 % 101, i) for i in range(101)] + [("a", 1, 200), ("b", 5, 301), ("b", 4, 300), (None, 1, 400)]
    n = numbered(spark.createDataFrame(rows, "k string, t int, i int"), "k", ["t", "i"])
    got = {(r.k, r.i): r.n for r in n.collect()}
    for k in ("hot", "a", "b", None):
        ids = [x[2] for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))]
        assert [got[k, i] for i in ids] == list(range(len(ids)))
    w = row_windows(n.where("k IS NOT NULL"), "k", "n", 3, ["i"]).collect()
    assert len(w) == 99 and all([x.n for x in r.rows] == [r.start, r.start + 1, r.start + 2] for r in w)
    c = {(r.k, r.chunk): len(r.rows) for r in row_chunks(n, "k", "n", 4, ["i"]).collect()}
    assert c == {("hot", i): 4 for i in range(25)} | {("b", 0): 2}


def test_islands(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, 1.0, 3.5, 4.0, 9.0])] + [("b", 9.5, 9)], "k string, t double, i int")
    got = {r.i: r.island for r in islands(df, "k", "t", "i", 2.0, inclusive=False).collect()}
    assert len({got[0], got[1]}) == 1 and len({got[2], got[3]}) == 1 and len(set(got.values())) == 4
