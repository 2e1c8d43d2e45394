"""Nearest vectors, tokens and leaked passages against brute force and public encoders."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contamination as C
from tidemark.llm import tokens as T
from tidemark.llm import vectors as V


def brute(ids, x, k, radius):
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    out = {}
    for i in range(len(x)):
        best = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i and (radius is None or d[i, j] <= radius))[:k]
        out[ids[i]] = [j for _, j in best]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id long, e array<float>").withColumns({"v": F.lit(1), "leaf": F.lit(2), "other": F.lit(3)})


def test_exact_in_one_leaf_with_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[40:90] = x[7]  # a quarter are copies of one vector
    x[90:95] = x[7] + np.float32(0.01)
    ids = rng.permutation(1000)[:200]
    bad = spark.createDataFrame([(5001, [float("nan")] * 8), (5002, [0.0] * 8), (5003, [1.0]), (5004, None), (5005, [float("inf")] + [0.0] * 7)], "id long, e array<float>")
    df = table(spark, ids, x).select("id", "e").unionByName(bad)
    for radius in (None, 0.5):
        got = {}
        for r in V.nearest_vectors(df, "id", "e", 5, radius, dims=8).orderBy("id", "distance", "other").collect():
            got.setdefault(r.id, []).append(r.other)
        want = {i: v for i, v in brute(ids.tolist(), x, 5, radius).items() if v}
        assert got == want
    assert V.nearest_vectors(df.limit(0), "id", "e", 5, 0.5, dims=8).count() == 0


def test_tree_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2400:] = x[:600] + rng.normal(size=(600, 16)).astype(np.float32) * np.float32(0.05)
    ids = np.arange(3000)
    got = {}
    for r in V.nearest_vectors(table(spark, ids, x), "id", "e", 10, 0.15, dims=16, leaf_rows=100).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(ids.tolist(), x, 10, 0.15)
    hits = sum(len(got.get(i, set()) & set(v)) for i, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.95


def test_tree_recall_without_a_radius(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x[3000:3040] = x[7]  # copies, more than k
    ids = rng.permutation(9000)[:4000]
    rows = V.nearest_vectors(table(spark, ids, x), "id", "e", 10, dims=16, leaf_rows=100).orderBy("id", "distance", "other").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.other)
    assert set(got) == set(ids.tolist()) and all(len(v) == 10 for v in got.values())
    want = brute(ids.tolist(), x, 10, None)
    assert got[int(ids[7])] == want[int(ids[7])]
    assert sum(len(set(got[i]) & set(v)) for i, v in want.items()) / 40_000 >= 0.95


def test_a_crowd_within_the_radius(spark, monkeypatch):
    """Unequal near-copies, all within the radius of each other: k a row are kept, whatever the slices."""
    rng = np.random.default_rng(12)
    x = (1 + rng.normal(size=(700, 8)) * 0.01).astype(np.float32)
    want = brute(list(range(700)), x, 5, 0.15)
    for pairs in (V.PAIRS, 64):
        monkeypatch.setattr(V, "PAIRS", pairs)
        entries = [{"id": i, "v": v.tobytes(), "mask": 1, "home": 0, "asks": True} for i, v in enumerate(x)]
        got = {}
        for r in V._search_group(V.pd.DataFrame(entries), 5, 0.15).sort_values(["id", "distance", "other"]).itertuples():
            got.setdefault(r.id, []).append(r.other)
        assert got == want


def test_calibration_rests_on_real_pairs():
    """Real pairs are a whole radius apart and few; displaced vectors are nearer and would ask for fewer visits."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12_000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.normal(size=(350, 16)).astype(np.float32)
    x[-350:] = x[:350] + step * np.float32(np.sqrt(0.149)) / np.linalg.norm(step, axis=1, keepdims=True)
    t = V.fit_tree(x, 150)
    visits = V.calibrate(t, x, 10, 0.15, 0.99)
    i, j = np.concatenate([np.arange(350), np.arange(11_650, 12_000)]), np.concatenate([np.arange(11_650, 12_000), np.arange(350)])
    hit = (V.best_bins(t, x[i], visits) == V.best_bins(t, x[j], 1)).any(1).mean()
    assert hit >= 0.98


def test_a_radius_search_goes_to_few_leaves():
    """Leaves are ranked over the whole tree and both vectors of a pair go to theirs; one branch after the other took far more."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(6_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.normal(size=(600, 64)).astype(np.float32)
    x[-600:] = x[:600] + step * np.float32(np.sqrt(0.14)) / np.linalg.norm(step, axis=1, keepdims=True)
    t = V.fit_tree(x, 8)
    leaves = V.Leaves(t)
    d = V._squared(x[:300], leaves.centroids[: leaves.count, :-1])
    assert leaves.wide and (np.sort(np.take_along_axis(d, leaves.best(x[:300], 5), 1), 1) - np.sort(d, 1)[:, :5]).max() < 1e-5
    visits = V._calibrated(leaves, x, 0.15, 10, 0.99)
    a, b = leaves.best(x[:600], visits), leaves.best(x[-600:], visits)
    assert (a[:, :, None] == b[:, None]).any((1, 2)).mean() >= 0.98
    assert visits * 4 <= V.calibrate(t, x, 10, 0.15, 0.99)


def test_pairs_within_a_radius_beside_brute_force(monkeypatch):
    """Blocks, their parts, crowds, copies and very long vectors."""
    rng = np.random.default_rng(22)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = 1 + rng.normal(size=(300, 8)) * 0.02
    x[400:420] = x[5]
    x[420:424] *= np.float32(1e5)
    x[424], x[425], x[426] = x[420], x[420], np.float32(1e30)
    x[427] = x[426]
    ids = rng.permutation(5_000)[:900]
    want = brute(ids.tolist(), x, 5, 0.15)
    for rows, columns, parts in ((V.ROWS, V.COLUMNS, 1), (64, 128, 3)):
        monkeypatch.setattr(V, "ROWS", rows)
        monkeypatch.setattr(V, "COLUMNS", columns)
        got = {}
        found = [V._search_leaves(V.pa.table({"id": ids, "v": [v.tobytes() for v in x], "mask": [3] * 900, "part": [p] * 900, "parts": [parts] * 900}), 5, 0.15) for p in range(parts)]
        one, other, distance = V._nearest(*(np.concatenate([t[c].to_numpy() for t in found]) for c in ("id", "other", "distance")), 5)
        for i, j in zip(one, other):
            got.setdefault(int(i), []).append(int(j))
        assert got == {i: v for i, v in want.items() if v}


def test_groups_hold_each_leaf_once():
    t = V.fit_tree(np.random.default_rng(6).normal(size=(2000, 4)).astype(np.float32), 20)
    group, place = t.groups()
    leaves = [n for n, c in enumerate(t.children) if not len(c)]
    assert len({(group[n], place[n]) for n in leaves}) == t.leaves > V.GROUP_LEAVES and place.max() < V.GROUP_LEAVES


def test_neighbors_of_every_vector(spark, tmp_path):
    """p2_neighbors has ten rows for each vector, far ones too."""
    x = np.random.default_rng(8).normal(size=(300, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "memory_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/memory_vectors.parquet")
    got = {}
    for r in V.p2_neighbors(spark, str(tmp_path)).orderBy("memory_id", "distance", "neighbor_id").collect():
        got.setdefault(r.memory_id, []).append(r.neighbor_id)
    assert got == brute(list(range(300)), x, 10, None)
    assert V.p2_found(spark, str(tmp_path)).count() == 0


def test_best_bins_visit_all_leaves():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    t = V.fit_tree(x, 20)
    bins = V.best_bins(t, x[:50], t.leaves)
    assert (bins >= 0).all() and all(len(set(b)) == t.leaves for b in bins)
    assert V.best_bins(t, x[:5], t.leaves + 3)[:, -3:].max() == -1


TEXTS = ["", None, "hello world", "  two  spaces\n\n and\ttabs ", "It's we'll I'M", "naïve café ﬁlter 温度計 مرحبا 😀👍🏽", "x" * 700, "<|endoftext|> is text", "  nbsp", "0123456789 12,345.678e-9 ½", "\x00\x1c\x7f", "ааа" * 120, " " * 300 + "end", "zkvqj wxqzt", "é combining"]


@pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no vocabulary files")
def test_tokens_equal_the_public_encoder_and_decode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(7, TEXTS[7]), (None, "null id"), (99, " ".join(random.Random(4).choice(["zkvqj", "hello", "wxqzt"]) for _ in range(400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p": F.lit(1), "h": F.lit(2), "ids": F.lit(3), "g": F.lit(4)})
    got = T.encode_corpus(df, "doc_id", "text").select("doc_id", "ids", T.decode_ids(F.col("ids")).alias("back")).collect()
    assert len(got) == len(rows)
    want = {i: (t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in rows}
    for r in got:
        assert (list(r.ids), r.back) == want[r.doc_id], r.doc_id
    assert T.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no vocabulary files")
def test_a_frequent_long_piece_and_rare_ones(spark, monkeypatch):
    """A separator of 80 signs in every document is no hot join key; with no piece in the plan all come back by the lookup."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.RANKS.replace(".tiktoken", ".json"))
    rows = [(i, f"head {i}\n{'=-' * 40}\nzkvqj{i % 3} wxqzt") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}
    for pieces in (T.PLAN_PIECES, 0):
        monkeypatch.setattr(T, "PLAN_PIECES", pieces)
        assert {r.doc_id: list(r.ids) for r in T.encode_corpus(df, "doc_id", "text").collect()} == want


@pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no vocabulary files")
def test_heap_equals_fold(spark):
    ranks = T.read_ranks()
    words = ["colander", "zkvqj", "aaaaaaaaaaaa", "Ã©t"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.fold_merges(F.col("w"), T._literal(ranks, "int")).alias("ids")).collect()
    assert all(list(r.ids) == T.heap_merges(r.w, ranks) for r in got)


def test_leaks(spark):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words)), (2, "Pour 3 grams of rice for Ana before second 14 and stop the timer at once"), (3, "short one"), (4, ""), (5, None), (6, "...")]
    docs = [
        (1, "x " + ", ".join(words[5:17]).upper() + " y"), (2, " ".join(words[5:16])), (3, "pour 9 grams of rice for Bo before second 20 and stop the timer at once"), (4, "POUR 3 grams of rice for ana before second 14, and stop the timer at once!"), (5, "a short, One b"),
        (6, None), (7, ""), (8, "short"), (9, "pour 9 grams of rice for Bo before second 9 and stop the timer at once"), (1, "x " + ", ".join(words[5:17]).upper() + " y"), (10, "w " * 5000 + " ".join(words)),
    ]
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"w": F.lit(1), "n": F.lit(2), "h1": F.lit(3), "slots": F.lit(4)})
    I = spark.createDataFrame(items, "item_id long, text string").withColumn("lead", F.lit(1))
    got = {(r.doc_id, r.item_id, r.kind) for r in C.leaked_items(D, I, "doc_id", "text", "item_id", "text", ["ana", "bo"]).collect()}
    exact = {(d, i) for d, i, k in got if k == "exact"}
    assert exact == {(1, 1), (4, 2), (5, 3), (10, 1)}
    # 3, 14 became 9, 20 (one for one); 9 stands for both 3 and 14 in document 9, so its long windows are not consistent
    assert (3, 2, "reparameterised") in got and (9, 2, "exact") not in got
    assert C.leaked_items(D.limit(0), I, "doc_id", "text", "item_id", "text", []).count() == 0
    assert C.leaked_items(D, I.limit(0), "doc_id", "text", "item_id", "text", []).count() == 0


def test_leaks_do_not_depend_on_the_plan(spark, monkeypatch):
    """A one-word item beside long ones keeps the pruning of these; joins without broadcast, names by a join, a full bitmap and a hot
    template give the same rows."""
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)] + ["ana", "bo", "seconds"] + [str(i) for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, "w7"), (2, "w1 w2 w3"), (3, " ".join(str(i) for i in range(12))), (4, " ".join(["5"] * 12)), *[(i, text(20)) for i in range(5, 15)]]
    docs = [(i, " ".join([text(10), rng.choice(items)[1], text(5)])) for i in range(40)] + [(100 + i, " ".join(str(i + j) for j in range(12))) for i in range(60)] + [(200, " ".join(["9"] * 30))]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    run = lambda names: sorted(map(tuple, C.leaked_items(D, I, "doc_id", "text", "item_id", "text", names).collect()))
    want = run(["ana", "bo"])
    assert (101, 3, "reparameterised", 1) in want and (100, 3, "exact", 1) in want and (200, 4, "reparameterised", 1) in want and (200, 3, "reparameterised", 1) not in want
    assert {d for d, i, k, _ in want if i == 1 and k == "exact"} == {d for d, x in docs if "w7" in x.split()}
    monkeypatch.setattr(C, "BROADCAST_WINDOWS", 0)
    assert run(["ana", "bo"]) == want
    assert run(spark.createDataFrame([("ana",), ("bo",), ("bo",)], "word string")) == want
    monkeypatch.setattr(C, "LEAD_BITS", 1 << 6)
    assert run(["ana", "bo"]) == want


def test_all_names_of_the_roster_are_slots(spark, tmp_path):
    spark.createDataFrame([(i, f"given{i:04d}", "Zyx" if i else "Aaa") for i in range(2_100)], "person_id long, given_name string, family_name string").write.parquet(f"{tmp_path}/roster.parquet")
    text = "hand the pan to {} and then wait until the rice is done"
    spark.createDataFrame([(1, text.format("zyx"))], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(1, text.format("Given2099")), (2, text.format("nobody"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(C.roster_names(spark, str(tmp_path))) == 2_102
    assert {(r.doc_id, r.item_id, r.kind) for r in C.p8_leaks(spark, str(tmp_path)).collect()} == {(1, 1, "reparameterised")}
