"""Frequencies, runs, nearest times and formatting duplicates against brute force."""

import json
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import formatting_duplicates as D
from tidemark.llm import frequency as Q
from tidemark.llm import nearest_time as N
from tidemark.llm import runs as R


def test_ngrams_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "f" if i % 3 else "g", [[r.choice(["a", "a", "b", "c", None]) for _ in range(r.randint(0, 6))] for _ in range(r.randint(0, 4))]) for i in range(300)]
    rows += [(301, "f", None), (302, "f", []), (303, None, [["a", "b"]]), (304, "f", [["a"] * 40])]
    occ, rec = Counter(), Counter()
    for _, f, seqs in rows:
        seen = set()
        for s in seqs or []:
            for i in range(len(s)):
                for n in range(1, min(3, len(s) - i) + 1):
                    occ[f, tuple(s[i : i + n])] += 1
                    seen.add((f, tuple(s[i : i + n])))
        rec.update(seen)
    df = spark.createDataFrame(rows, "id long, f string, s array<array<string>>").withColumns({"suffix": F.lit(1), "lcp": F.lit(1), "n": F.lit(2), "terms": F.lit("x")})
    for salts in (None, 1, 8):
        got = {(x.field, tuple(x.terms)): (x.occurrences, x.records) for x in Q.prefix_counts(df, "f", "s", sigma=3, salts=salts).collect()}
        assert got == {k: (occ[k], rec[k]) for k in occ}
    assert Q.prefix_counts(df.limit(0), "f", "s").count() == 0


def test_terms_and_spaces(spark):
    rows = [(["  Meal  Prep ", "meal prep", "", None, " "], None, "Action\t"), (None, ["x"], None), ([], [], " ")]
    df = spark.createDataFrame(rows, "topics array<string>, tasks array<string>, intent string")
    got = {(x.field, x.term): (x.occurrences, x.records) for x in Q.term_frequencies(df).collect()}
    assert got == {("topics", "meal prep"): (2, 1), ("intent", "action"): (1, 1), ("tasks", "x"): (1, 1)}


def test_a_hot_first_term_is_spread(spark):
    rows = [("f", ["hot", f"t{i}"]) for i in range(300)] + [("f", [f"u{i}"]) for i in range(300)] + [(None, ["hot"])]
    summed = spark.createDataFrame(rows, "field string, suffix array<string>")
    assert [(r.field, r["head"], r.salts) for r in Q._salts(summed, 8).collect()] == [("f", "hot", 8)]
    assert Q._salts(summed.limit(0), 8).count() == 0


def near(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_runs_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot"] * 5 + ["b", None]), r.randint(0, 300), " ".join(r.choice("ab") for _ in range(r.randint(0, 4))) if r.random() > 0.05 else None) for i in range(500)]
    df = spark.createDataFrame([(i, v, s, s + i % 7, t) for i, v, s, t in rows], "id long, v string, s long, e long, text string").withColumns({"run": F.lit(1), "prev": F.lit(2), "k": F.lit(3)})
    got = {(x.v, x.first_id, x.last_id, x.events, x.end_at) for x in R.collapse_runs(df, "v", ["s", "id"], "id", "s", "e", "text").collect()}
    want = set()
    for v in ("hot", "b", None):
        run = []
        for i, _, s, t in sorted((x for x in rows if x[1] == v), key=lambda x: (x[2], x[0])) + [(None, None, None, None)]:
            w = re.findall(r"\w+", (t or "").lower())
            if run and (i is None or not near(run[-1][1], w)):
                want.add((v, run[0][0], run[-1][0], len(run), max(x[2] for x in run)))
                run = []
            run.append((i, w, 0 if i is None else s + i % 7))
    assert got == want
    assert R.collapse_runs(df.limit(0), "v", ["s", "id"], "id", "s", "e", "text").count() == 0


def test_copies(spark):
    df = spark.createDataFrame([(3, "v", "b"), (1, "v", "b"), (2, "w", "b")], "memory_id long, video_id string, block_id string")
    assert sorted(r.memory_id for r in R.without_copies(df).collect()) == [1, 2]


def test_nearest_against_brute_force(spark):
    r = random.Random(3)
    left = [(r.choice(["hot", "hot", "b", None]), r.choice([r.randint(-50, 9000), None, 40]), i) for i in range(400)]
    right = []
    for i in range(120):
        s = r.randint(0, 9000)
        right.append((r.choice(["hot", "b", None]), s, s + r.choice([0, 5, 60, 700, 4000, -3]), i))
    right += [("hot", 40, 45, 500), ("hot", 40, 45, 499), ("b", 0, 10**7, 600)]
    L = spark.createDataFrame(left, "k string, t long, left_id long").withColumn("tick", F.lit(1))
    Rt = spark.createDataFrame(right, "k string, s long, e long, id long").withColumns({"level": F.lit(1), "c": F.lit(2)})
    want = {}
    for k, t, i in left:
        best = min(((max(s - t, t - e, 0), s, j) for kk, s, e, j in right if k is not None and kk == k and s <= e and t is not None), default=None)
        if best and best[0] <= 50:
            want[i] = (best[2], best[0])
    for tick in (None, 7):
        assert {x.left_id: (x.id, x.distance) for x in N.match_nearest(L, Rt, 50, tick).collect()} == want
    assert N.match_nearest(L, Rt.limit(0), 50).count() == 0 and N.match_nearest(L.limit(0), Rt, 50).count() == 0


def test_formatting(spark):
    p = lambda **k: json.dumps(k)
    rows = [
        (1, p(visual_caption="A pan.", speech_text="x")), (2, '{"speech_text": "X ", "visual_caption": "a   PAN"}'), (3, p(visual_caption="A pan.", speech_text="x")), (4, p(visual_caption="A panx")), (5, p(visual_caption=None, speech_text=None)),
        (6, "{"), (7, "[]"), (8, None), (9, ""), (10, '{"visual_caption": "q",}'), (11, p(visual_caption="Ünï", other=1)), (12, p(visual_caption="ünï", speech_text="")), (13, '{"visual_caption": 5, "speech_text": "z"}'), (14, p(speech_text="Z")), (15, '{"visual_caption": "a"} x'),
    ]
    rows += [(100 + i, p(visual_caption="hot" + "!" * (i % 50))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, p string").withColumns({"h": F.lit(1), "n": F.lit(2), "canon": F.lit("c")})
    got = {x.i: (x.keep_id, x.copies) for x in D.collapse_formatting(df, "i", "p", ["visual_caption", "speech_text"]).collect()}
    want = {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 11: (11, 2), 12: (11, 2), 13: (13, 2), 14: (13, 2)} | {100 + i: (100, 400) for i in range(400)}
    assert got == want
    assert D.collapse_formatting(df.limit(0), "i", "p", ["visual_caption", "speech_text"]).count() == 0
