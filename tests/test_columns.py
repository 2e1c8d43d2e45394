"""Column builders against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.folds import keep_apart, keep_spaced
from tidemark.operators.intervals import finite, valid_range


def one(spark, value, kind, *cols):
    return spark.createDataFrame([(v,) for v in value], f"x {kind}").select(*[c(F.col("x")) for c in cols]).collect()


def test_strip_takes_unicode_space(spark):
    got = one(spark, ["  a b ", None, "", "\t"], "string", C.strip, C.nonblank)
    assert [tuple(r) for r in got] == [("a b", True), (None, False), ("", False), ("", False)]


def test_clock_grammar(spark):
    good = {"01:02:03.125": 3723.125, "00:00:00": 0.0, "123:59:59.123456789": 123 * 3600 + 59 * 60 + 59.123456789}
    bad = ["1.25", "NaN", "00:60:01", "00:00:60", "-01:00:00", " 00:00:01", "0:00:01", None, "00:00:01\n", "00:00:01.1234567890"]
    got = [r[0] for r in one(spark, [*good, *bad], "string", C.clock_seconds)]
    assert got[: len(good)] == pytest.approx(list(good.values())) and got[len(good) :] == [None] * len(bad)


def test_formats(spark):
    got = one(spark, ["a" * 64, "A" * 64, "a" * 64 + "\n", None], "string", C.sha256_hex)
    assert [r[0] for r in got] == [True, False, False, False]
    urls = {"https://a.b/c": True, "http://a.b": False, "https://u:p@a.b": False, "https:///x": False, "": False, None: False, "https://a b": False}
    assert [r[0] for r in one(spark, list(urls), "string", C.https_url)] == list(urls.values())
    ids = {"P00_1.x": True, "../x": False, ".x": False, "a/b": False, "": False, None: False, "a\n": False}
    assert [r[0] for r in one(spark, list(ids), "string", C.safe_id)] == list(ids.values())


def test_fence(spark):
    cases = {"```json\n{}\n```": "{}", "```\n{}\n```": "{}", "{}": "{}", "```{}": "```{}", "```json\n{\n}": "{", "json {}": "{}"}
    assert [r[0] for r in one(spark, list(cases), "string", C.without_fence)] == list(cases.values())


def test_finite_and_ranges(spark):
    got = one(spark, [1.0, float("nan"), float("inf"), None], "double", finite)
    assert [bool(r[0]) for r in got] == [True, False, False, False]
    got = one(spark, [[0.0, 0.0], [2.0, 1.0], [0.0], [0.0, float("nan")], None, [0.0, 1.0, 2.0], [None, 1.0]], "array<double>", valid_range)
    assert [r[0] for r in got] == [True, False, False, False, False, False, False]


def test_hamming(spark):
    a, b = "0" * 64, "f" + "0" * 62 + "1"
    df = spark.createDataFrame([(a, b), (a, a), ("f" * 64, a)], "a string, b string")
    assert [r[0] for r in df.select(C.hamming_hex(F.col("a"), F.col("b"))).collect()] == [5, 0, 256]


def test_half_even_positions(spark):
    df = spark.createDataFrame([(i, last, n) for last in range(0, 12) for n in (2, 3, 4) for i in range(n)], "i int, l int, n int")
    for r in df.select("i", "l", "n", C.even_position(F.col("i"), F.col("l"), F.col("n")).alias("p")).collect():
        assert r.p == round(r.i * r.l / (r.n - 1))


def test_increasing(spark):
    got = one(spark, [[1.0, 2.0], [1.0, 1.0], [1.0], [], [1.0, 3.0, 2.0]], "array<double>", C.strictly_increasing)
    assert [r[0] for r in got] == [True, False, True, True, False]


def test_folds_against_python(spark):
    import random

    r = random.Random(1)
    rows = [([r.uniform(0, 20) for _ in range(r.randint(0, 30))],) for _ in range(40)]
    got = spark.createDataFrame(rows, "x array<double>").select("x", keep_apart(F.col("x"), 1.5).alias("a"), keep_spaced(F.array_sort("x"), 1.5).alias("b")).collect()
    for x, a, b in got:
        want = []
        for t in x:
            if not any(t >= w - 1.5 and t <= w + 1.5 for w in want):
                want.append(t)
        assert a == want
        want, last = [], None
        for t in sorted(x):
            if last is None or t - last >= 1.5:
                want.append(t)
                last = t
        assert b == want


def test_evidence_rules(spark):
    ok = dict(evidence_id="e", claim=" c ", start_sec=0.5, end_sec=0.8, source_type="human_review", verification_status="accepted_independent_evidence", accepted_as_fact=True, acceptance_provenance=dict(method="independent_human_review", reviewer_or_system="r", source_evidence_ids=["s"]))
    spoiled = [{}, {"claim": " "}, {"start_sec": 1.0}, {"end_sec": math.inf}, {"accepted_as_fact": None}, {"verification_status": "x"}, {"source_type": "model"}, {"evidence_id": ""}, {"acceptance_provenance": ok["acceptance_provenance"] | {"method": "model"}}, {"acceptance_provenance": ok["acceptance_provenance"] | {"source_evidence_ids": []}}, {"acceptance_provenance": None}]
    df = spark.createDataFrame([ok | s for s in spoiled], "evidence_id string, claim string, start_sec double, end_sec double, source_type string, verification_status string, accepted_as_fact boolean, acceptance_provenance struct<method:string,reviewer_or_system:string,source_evidence_ids:array<string>>")
    got = [r[0] for r in df.select(C.policy_accepted(F.struct(*df.columns))).collect()]
    assert got == [True] + [False] * (len(spoiled) - 1)
