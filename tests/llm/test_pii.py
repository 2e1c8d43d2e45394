"""The tagger on held-out texts, its decoder against brute force, and hand-written fixtures."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import held_out_pii
from tidemark.llm import pii
from tidemark.llm.labelled import SENTENCES, STREET_TYPES, labelled_table


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.trained_tagger(spark)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    s, moves, first = rng.normal(size=(3, 4, 11)).astype(np.float32), rng.normal(size=(11, 11)).astype(np.float32), rng.normal(size=11).astype(np.float32)
    got = pii.viterbi(s, np.array([4, 2, 1]), moves, first)
    for b, n in enumerate([4, 2, 1]):
        score = lambda p: first[p[0]] + sum(s[b, i, y] for i, y in enumerate(p)) + sum(moves[a, c] for a, c in zip(p, p[1:]))
        assert tuple(got[b, :n]) == max(itertools.product(range(11), repeat=n), key=score)


def test_held_out_texts_are_in_no_labelled_row(tagger):
    table = "\n".join(x.lower() for x, _ in labelled_table(pii.slot_words(tagger.common)))
    words = set(re.findall(r"[^\W\d_]+", table))
    assert held_out_pii.name_parts() & words <= set(STREET_TYPES) | {"calle", "rue"}
    fixed = [p.strip().lower() for line in held_out_pii.TEXTS for p in re.split(r"\[[A-Z_]+ (?:[^\[\]]|\[at\])+\]|\{[A-Z_]+ [^{}]+\}", line)]
    assert not [p for p in fixed if len(p) >= 12 and p in table]


def scores(found, rows):
    hit = made = real = 0
    for (_, spans), got in zip(rows, found):
        a, b = set(spans), set(got)
        hit, made, real = hit + len(a & b), made + len(b), real + len(a)
    return hit / made, hit / real


def test_held_out_accuracy(tagger):
    rows = held_out_pii.rows()
    texts = [r[0] for r in rows]
    checked, bare = scores(pii.find_spans(tagger, texts), rows), scores(pii.tag_texts(tagger, texts), rows)
    print("precision, recall with and without the exact check:", checked, bare)
    assert min(checked) > 0.9 and min(bare) > 0.85


def test_long_texts_are_tagged_like_short_ones(tagger):
    one = "The invoice was approved by Gwendolyn Achterberg. "
    spans = pii.find_spans(tagger, [one * 400])[0]
    assert len(spans) == 400 and all(k == "NAME" for _, _, k in spans)


def test_weights_are_saved_and_loaded(spark, tagger, monkeypatch):
    monkeypatch.setattr(pii, "_TRAINED", {})
    monkeypatch.setattr(pii, "train", pii.train)
    again = pii.trained_tagger(spark)  # from the shared folder
    assert again is not tagger and again.index == tagger.index and np.array_equal(again.weights, tagger.weights)
    texts = [held_out_pii.parsed(x)[0] for x in held_out_pii.TEXTS]
    assert pii.find_spans(again, texts) == pii.find_spans(tagger, texts)


ROWS = [(1, "Signed by Jorunn Achterberg in May. Email: jorunn.d@brightkettle.ie"), (2, None), (3, ""), (4, "   "), (None, "Phone: 07911 900323"), (5, "peel the lemon"), (1, "peel the lemon"), (6, "They live at 108 Thistledown Lane.\nPassport no. ZX5652838")]


def test_rows(spark, tagger):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"spans": F.lit(1), "redacted": F.lit(2), "id": F.lit(3), "g": F.lit(4), "word": F.lit("x")})
    got = pii.find_personal(df, "doc_id", "text", tagger).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.redacted): [(s.kind, s.span) for s in r.spans] for r in got}
    assert by[1, "Signed by <NAME> in May. Email: <EMAIL>"] == [("NAME", "Jorunn Achterberg"), ("EMAIL", "jorunn.d@brightkettle.ie")]
    assert by[2, None] == [] and by[3, ""] == [] and by[4, "   "] == [] and by[1, "peel the lemon"] == []
    assert by[None, "Phone: <PHONE>"] == [("PHONE", "07911 900323")]
    assert by[6, "They live at <ADDRESS>.\nPassport no. <ID_NUMBER>"] == [("ADDRESS", "108 Thistledown Lane"), ("ID_NUMBER", "ZX5652838")]
    assert pii.find_personal(df.limit(0), "doc_id", "text", tagger).count() == 0


def test_known_names_by_broadcast_and_by_join(spark, tagger, monkeypatch):
    people = spark.createDataFrame([("Jorunn", "Achterberg"), ("Anne-Sofie", None), (None, "lemon")], "given_name string, family_name string")
    names = pii.known_words(people)
    assert {tuple(r) for r in names.collect()} == {("jorunn", True, False), ("achterberg", False, True), ("anne", True, False), ("sofie", True, False), ("lemon", False, True)}
    df = spark.createDataFrame([*ROWS, (7, "jorunn achterberg"), (7, "jorunn achterberg"), (8, "JORUNN ACHTERBERG")], "doc_id long, text string")
    key = lambda rows: sorted((str(r.doc_id), str(r.redacted), str(r.spans)) for r in rows)
    few = key(pii.find_personal(df, "doc_id", "text", tagger, names).collect())
    monkeypatch.setattr(pii, "BROADCAST_NAMES", 1)
    many = key(pii.find_personal(df, "doc_id", "text", tagger, names).collect())
    assert few == many and len(few) == len(ROWS) + 3


def test_exact_check():
    t = "Someone reads 666-27-6229 from an identity card. mail a.b [at] c.example now"
    assert pii.exact_span(t, 14, 25, "ID_NUMBER") == (14, 25) and pii.exact_span(t, 0, 7, "ID_NUMBER") is None
    a = t.index("a.b")
    assert t[slice(*pii.exact_span(t, a, a + 3, "EMAIL"))] == "a.b [at] c.example"
    n = "in Jorunn Achterberg's kitchen"
    assert pii.exact_span(n, 3, 22, "NAME") == (3, 20) and pii.exact_span(n, 3, 9, "NAME") is None
    assert pii.exact_span(n, 0, 22, "NAME") == (3, 20) and pii.exact_span("Ask the old gardener", 4, 11, "NAME") is None
    v = "It was Ana van der Berg."
    assert pii.exact_span(v, 4, 23, "NAME") == (7, 23)


def test_every_sentence_is_labelled():
    rows = labelled_table(["thing", "other"], 0)
    assert len(rows) == len(SENTENCES) and all(x[a:b] for x, spans in rows for a, b, _ in spans)
