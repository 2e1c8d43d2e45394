"""The most similar vectors of every vector (problem 2): a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.skew import lookup
from tidemark.session import cut, table

#: The tree is fitted on at most this many vectors (16 MB of 64 floats); every vector is indexed.
SAMPLE_ROWS = 65_536
#: Vectors that a leaf should hold. A collection of up to four leaves' worth is one leaf and searched exactly.
LEAF_ROWS = 1_000
BRANCHES = 16
#: Real pairs within a radius on which the visits are calibrated, if the sample has so many.
REAL_PAIRS = 500
#: Leaves that are searched together: a vector that visits several of them travels there once.
GROUP_LEAVES = 16
#: Entries that one task of the leaf search takes at once.
BLOCK_ROWS = 65_536
#: Leaves that are compared as one when the nearest are looked for.
FOLD = 16
#: Rows and columns of one matrix of distances (2 MB, within a core's cache).
ROWS, COLUMNS = 256, 2_048
#: Vectors with many copies that travel by broadcast (some 10 MB).
BROADCAST_ROWS = 200_000


@dataclass
class Tree:
    """Nodes 1.. have a centroid; children[n] are the nodes below n, none for a leaf. Node 0 is the root."""

    centroids: np.ndarray
    children: list[np.ndarray]
    visits: int = 1

    @property
    def leaves(self) -> int:
        return sum(not len(c) for c in self.children)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each node that is a leaf the group and its place there: leaves in the order of the tree, GROUP_LEAVES to a group."""
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            if len(self.children[node]):
                todo.extend(self.children[node])
            else:
                order.append(node)
        rank = np.zeros(len(self.children), np.int64)
        rank[order] = np.arange(len(order))
        return rank // GROUP_LEAVES, rank % GROUP_LEAVES


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T), 0.0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _squared(x, c).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = (at == np.arange(k)[:, None]).astype(np.float32) @ x
        full = n > 0
        c[full] = (sums[full] / n[full, None]).astype(np.float32)
    at = _squared(x, c).argmin(1)
    used = np.unique(at)
    return c[used], np.searchsorted(used, at)


def fit_tree(sample: np.ndarray, leaf_rows: int, seed: int = 7) -> Tree:
    """Split the sample by k-means until a node holds at most `leaf_rows` of it (dense regions get deeper), or cannot be split."""
    rng = np.random.default_rng(seed)
    centroids, children, todo = [np.zeros(sample.shape[1], np.float32)], [np.empty(0, np.int64)], [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        c, at = _kmeans(sample[rows], min(BRANCHES, max(2, -(-len(rows) // leaf_rows))), rng)
        if len(c) < 2:
            continue
        children[node] = np.arange(len(centroids), len(centroids) + len(c))
        for i in range(len(c)):
            todo.append((len(centroids), rows[at == i]))
            centroids.append(c[i])
            children.append(np.empty(0, np.int64))
    return Tree(np.stack(centroids), children)


def best_bins(tree: Tree, x: np.ndarray, visits: int) -> np.ndarray:
    """The first `visits` leaves of each row of x, best bin first; -1 where the tree has fewer.

    Each row has a priority queue of open nodes by distance of the centroid; its nearest is taken, and a leaf is a visit, while an
    inner node is replaced by its children. All rows advance together: the queues are the columns of one matrix.
    """
    n, wide = len(x), max((len(c) for c in tree.children), default=0)
    out = np.full((n, visits), -1, np.int32)
    if not len(tree.children[0]):
        out[:, 0] = 0
        return out
    inner = np.array([len(c) > 0 for c in tree.children])
    queue, nodes, at = np.full((n, 0), np.inf, np.float32), np.zeros((n, 0), np.int32), np.arange(n)
    done, expand = np.zeros(n, np.int64), [(0, at)]
    while True:
        more_d, more_n = np.full((n, wide), np.inf, np.float32), np.zeros((n, wide), np.int32)
        for node, rows in expand:
            c = tree.children[node]
            more_d[rows, : len(c)] = _squared(x[rows], tree.centroids[c])
            more_n[rows, : len(c)] = c
        if expand:
            queue, nodes = np.concatenate([queue, more_d], 1), np.concatenate([nodes, more_n], 1)
        j = queue.argmin(1)
        open_ = np.isfinite(queue[at, j]) & (done < visits)
        if not open_.any():
            return out
        taken = nodes[at, j]
        queue[at[open_], j[open_]] = np.inf
        leaf = open_ & ~inner[taken]
        out[at[leaf], done[leaf]] = taken[leaf]
        done[leaf] += 1
        todo = at[open_ & inner[taken]]
        todo = todo[np.argsort(taken[todo], kind="stable")]
        cuts = np.flatnonzero(np.diff(taken[todo])) + 1
        expand = [(int(taken[rows[0]]), rows) for rows in np.split(todo, cuts) if len(rows)]


def calibrate(tree: Tree, sample: np.ndarray, k: int, radius: float | None, recall: float, seed: int = 11, queries: int = 2_000) -> int:
    """The fewest leaf visits that reach `recall` on neighbours known by brute force within the sample.

    With a radius (squared), neighbours beyond it do not count, and more of the sample is asked until REAL_PAIRS are found, or all of it.
    Vectors displaced by up to the radius in random directions must then be found to the same recall, apart: real pairs may be few.
    """
    rng = np.random.default_rng(seed)
    if tree.leaves <= 1:
        return 1
    picked = rng.permutation(len(sample))[: queries if radius is None else None]
    ask, found, asked, pairs = [], [], 0, 0
    for part in np.array_split(picked, max(1, len(picked) // 100)):
        if asked >= queries and pairs >= REAL_PAIRS:
            break
        d = _squared(sample[part], sample)
        d[np.arange(len(part)), part] = np.inf
        rows = np.arange(len(part)) if radius is None else np.flatnonzero((d <= radius).any(1))
        near = np.argpartition(d[rows], min(k, d.shape[1] - 1), axis=1)[:, :k]
        i, j = np.nonzero(d[rows[:, None], near] <= (radius if radius is not None else np.finfo(np.float32).max))
        ask.append(part[rows[i]])
        found.append(near[i, j])
        asked, pairs = asked + len(part), pairs + len(i)
    known = [(sample[np.concatenate(ask)], sample[np.concatenate(found)])]
    if radius is not None:
        base = sample[rng.choice(len(sample), 1_000)]
        step = rng.normal(size=base.shape).astype(np.float32)
        step *= (np.sqrt(radius * rng.random((len(base), 1))) / np.linalg.norm(step, axis=1, keepdims=True)).astype(np.float32)
        known.append((base, base + step))
    return max(_visits_for(tree, q, x, recall) for q, x in known)


def _visits_for(tree: Tree, q: np.ndarray, x: np.ndarray, recall: float) -> int:
    """The fewest visits of q that find the leaf of its neighbour x in a share `recall` of the rows; 1 without rows."""
    if not len(q):
        return 1
    home = best_bins(tree, x, 1)[:, 0]
    once, at = np.unique(q, axis=0, return_inverse=True)
    visits, most = 2, tree.leaves
    while True:  # widen until the recall is reached; all leaves reach 1
        seen = best_bins(tree, once, min(visits, most))[at]
        hit = (seen == home[:, None]).cumsum(1).clip(0, 1).mean(0)
        if hit[-1] >= recall:
            return int(np.argmax(hit >= recall)) + 1
        visits *= 2


def _pack(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes: `dims` finite elements, not all zero."""
    for b in batches:
        v = b.column(1)
        size = np.asarray(v.value_lengths().fill_null(-1))
        keep = np.flatnonzero(size == dims)
        flat = v.take(pa.array(keep)).flatten()
        x = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(len(keep), dims) + np.float32(0)  # no negative zeros
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        raw = np.ascontiguousarray(x[ok])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep[ok])), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "v"])


#: Pairs whose exact distances are computed at once (32 MB of 64 doubles).
PAIRS = 65_536


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.float64) - b.astype(np.float64)) ** 2).sum(1)


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def _search_group(pdf: pd.DataFrame, k: int, radius: float | None) -> pd.DataFrame:
    """The k nearest of each asking row among the members of the leaves it visits (bits of `mask`). A member stands in leaf `home`, others have -1."""
    home = pdf["home"].to_numpy()
    m = pdf[home >= 0].drop_duplicates("id").sort_values(["home", "id"], kind="stable")
    q = pdf[pdf["asks"].to_numpy()]
    mid, mhome, qid, qmask, qhome = m["id"].to_numpy(), m["home"].to_numpy(), q["id"].to_numpy(), q["mask"].to_numpy(), q["home"].to_numpy()
    out = []
    if len(mid) and len(qid):
        mx, qx = _matrix(list(m["v"])), _matrix(list(q["v"]))
        # the product of (a, 1) and (b, -|b|^2 / 2) is half of |a|^2 less the squared distance: one pass over all pairs
        mm, qq = (mx * mx).sum(1), (qx * qx).sum(1)
        wide_m, wide_q = np.column_stack([mx, -mm / 2]), np.column_stack([qx, np.ones_like(qq)])
        slack = (1e-4 + 1e-5 * (qq + mm.max())).astype(np.float64)
        edges = np.searchsorted(mhome, np.arange(GROUP_LEAVES + 1))
        step = max(1, 4_000_000 // int(np.diff(edges).max()))
        for a in range(0, len(qid), step):
            block = slice(a, a + step)
            best = np.full((len(qid[block]), k), np.inf)  # the k smallest distances so far
            some = []
            for leaf in np.flatnonzero(np.diff(edges)):
                own, ask = slice(edges[leaf], edges[leaf + 1]), np.flatnonzero(qmask[block] >> leaf & 1)
                if not len(ask):
                    continue
                near, size = wide_q[a + ask] @ wide_m[own].T, edges[leaf + 1] - edges[leaf]
                here = np.flatnonzero(qhome[a + ask] == leaf)  # a vector is no neighbour of itself, and is a member of its home only
                if len(here):
                    at = np.minimum(np.searchsorted(mid[own], qid[a + ask[here]]), size - 1)
                    itself = mid[own][at] == qid[a + ask[here]]
                    near[here[itself], at[itself]] = -np.inf
                edge = np.full(len(ask), radius) if radius is not None else best[ask, -1]
                least = (qq[a + ask] - edge * 1.001 - slack[a + ask]) / 2  # a margin covers rounding; exact distances decide
                new = np.flatnonzero(np.isinf(edge))
                if len(new):
                    kth = np.partition(near[new], max(0, size - k), axis=1)[:, max(0, size - k)]
                    least[new] = kth - 0.0005 * np.maximum(qq[a + ask[new]] - 2 * kth, 0) - slack[a + ask[new]] / 2
                enough = near >= np.maximum(least, np.finfo(np.float32).min).astype(np.float32)[:, None]
                if radius is not None:  # of a crowd within the radius only what can be among the k nearest
                    many = np.flatnonzero(enough.sum(1) > k)
                    if len(many):
                        kth = np.partition(near[many], size - k, axis=1)[:, size - k]
                        kth = kth - 0.0005 * np.maximum(qq[a + ask[many]] - 2 * kth, 0) - slack[a + ask[many]] / 2
                        enough[many] &= near[many] >= kth.astype(np.float32)[:, None]
                i, j = np.nonzero(enough)
                exact = np.concatenate([_exact(qx[a + ask[i[s : s + PAIRS]]], mx[own][j[s : s + PAIRS]]) for s in range(0, max(1, len(i)), PAIRS)])
                ok = exact <= (radius if radius is not None else best[ask[i], -1])
                i, j, exact = i[ok], j[ok], exact[ok]
                some.append((ask[i], mid[own][j], exact))
                order = np.lexsort((exact, i))
                i, exact = i[order], exact[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                more = np.full((len(ask), k), np.inf)
                more[i[rank < k], rank[rank < k]] = exact[rank < k]
                best[ask] = np.sort(np.concatenate([best[ask], more], 1), axis=1)[:, :k]
            if some:
                i, other, exact = (np.concatenate(x) for x in zip(*some))
                ok = exact <= best[i, -1]
                i, other, exact = i[ok], other[ok], exact[ok]
                order = np.lexsort((other, exact, i))
                i, other, exact = i[order], other[order], exact[order]
                ok = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pd.DataFrame({"id": qid[a + i[ok]], "other": other[ok], "distance": exact[ok]}))
    return pd.concat(out) if out else pd.DataFrame({"id": np.empty(0, np.int64), "other": np.empty(0, np.int64), "distance": np.empty(0)})


class Leaves:
    """The leaves of a tree in its order, ranked for a vector by the distance of their centroids: whole ranks, where best_bins goes down
    one branch before it looks at the next. `size` leaves in a row are a group."""

    def __init__(self, tree: Tree, size: int = GROUP_LEAVES):
        group, place = tree.groups()
        leaf = np.flatnonzero([not len(c) for c in tree.children])
        c = tree.centroids[leaf[np.argsort((group * GROUP_LEAVES + place)[leaf])]]
        self.count, self.size, self.visits, self.parts = len(c), size, 1, np.ones(0, np.int64)
        self.wide = -(-len(c) // FOLD) if len(c) > 16 * FOLD else 0
        full = FOLD * self.wide or len(c)
        self.centroids = np.zeros((full, c.shape[1] + 1), np.float32)
        self.centroids[: len(c), :-1] = c
        self.centroids[: len(c), -1] = -(c * c).sum(1) / 2
        self.centroids[len(c) :, -1] = -np.inf

    def best(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The `visits` nearest leaves of each row of x, nearest first."""
        visits = min(visits, self.count)
        out = np.empty((len(x), visits), np.int64)
        for a in range(0, len(x), 256):
            near = np.column_stack([x[a : a + 256], np.ones(len(x[a : a + 256]), np.float32)]) @ self.centroids.T  # half of |x|^2 less the squared distance
            at = np.arange(len(near))[:, None]
            if self.wide and visits < self.wide:  # the nearest leaves are in the columns with the nearest
                folded = near.reshape(len(near), FOLD, self.wide).max(1)
                some = np.argpartition(folded, self.wide - visits, axis=1)[:, self.wide - visits :]
                some = (some[:, :, None] + self.wide * np.arange(FOLD)).reshape(len(near), -1)
            else:
                some = np.broadcast_to(np.arange(self.count), (len(near), self.count))
            top = np.argsort(-near[at, some], axis=1, kind="stable")[:, :visits]
            out[a : a + 256] = some[at, top]
        return out


def _within(x: np.ndarray, radius: float, k: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance), i < j, of the pairs of rows within the radius; in a crowd only pairs that can be among the k nearest of
    one of the two. Of the blocks of rows, every one of `parts` takes its own."""
    norm = (x.astype(np.float64) ** 2).sum(1)
    plain = norm < 1e6  # the others are few or none: their products would be too coarse
    half = (-np.minimum(norm, 1e30) * (1 - 2e-5) / 2).astype(np.float32)  # a margin in proportion to the norms covers rounding; exact distances decide
    one = np.ones_like(half)
    a, b, least = np.column_stack([x, half, one]), np.column_stack([x, one, half]), np.float32(-(radius * 1.001 + 1e-4) / 2)
    a[~plain], b[~plain] = 0, 0
    a[~plain, -2] = b[~plain, -1] = -np.inf
    a[~plain, -1] = b[~plain, -2] = 1
    pairs = []
    for n, s in enumerate(range(0, len(x), ROWS)):
        if n % parts != part:
            continue
        for t in range(s, len(x), COLUMNS):
            near = a[s : s + ROWS] @ b[t : t + COLUMNS].T
            enough = near > least
            if not enough.any():
                continue
            if t < s + ROWS:  # no row with itself, nor a pair twice
                enough &= np.arange(t, t + near.shape[1]) > np.arange(s, s + len(near))[:, None]
            if min(near.shape) > k and enough.sum() > 8 * k * len(near):
                near = np.where(enough, near, -np.inf)
                margin = 0.002 * radius + 1e-4 + 4e-5 * norm[plain].max()
                row, column = (np.partition(near, near.shape[d] - k, axis=d).take([near.shape[d] - k], axis=d) - margin for d in (1, 0))
                enough &= (near >= row) | (near >= column)
            i, j = np.nonzero(enough)
            i, j = i + s, j + t
            exact = np.concatenate([_exact(x[i[c : c + PAIRS]], x[j[c : c + PAIRS]]) for c in range(0, max(1, len(i)), PAIRS)])
            ok = exact <= radius
            pairs.append((i[ok], j[ok], exact[ok]))
    if part == 0:
        for i in np.flatnonzero(~plain):
            exact = _exact(x[i][None], x)
            j = np.flatnonzero((exact <= radius) & (plain | (np.arange(len(x)) > i)))
            pairs.append((np.minimum(i, j), np.maximum(i, j), exact[j]))
    return tuple(np.concatenate(p) for p in zip(*pairs)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _nearest(one: np.ndarray, other: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each `one` the k nearest `other`, equal distances by smaller id; a pair that comes again counts once."""
    order = np.lexsort((other, distance, one))
    one, other, distance = one[order], other[order], distance[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (other[1:] != other[:-1])
    one, other, distance = one[new], other[new], distance[new]
    ok = np.arange(len(one)) - np.searchsorted(one, one) < k
    return one[ok], other[ok], distance[ok]


def _calibrated(leaves: Leaves, sample: np.ndarray, radius: float, k: int, recall: float, seed: int = 11) -> int:
    """The fewest leaves of each of two vectors so that a share `recall` of pairs within the radius have one in common: of all such pairs
    of the sample, and apart of vectors displaced by up to the radius in random directions, as real pairs may be few."""
    if leaves.count <= 1:
        return 1
    rng = np.random.default_rng(seed)
    base = sample[rng.choice(len(sample), 2_000)]
    step = rng.normal(size=base.shape).astype(np.float32)
    step *= (np.sqrt(radius * rng.random((len(base), 1))) / np.linalg.norm(step, axis=1, keepdims=True)).astype(np.float32)
    i, j, _ = _within(sample, radius, k)
    some = rng.permutation(len(i))[:20_000]
    most = 1
    for x, y in ((base, base + step), (sample[i[some]], sample[j[some]])):
        visits, met = 4, not len(x)
        while not met:  # all leaves have one in common
            p, q = leaves.best(x, visits), leaves.best(y, visits)
            first = np.full(len(x), visits + 1)
            for n in range(p.shape[1]):
                for m in range(p.shape[1]):
                    first = np.where(p[:, n] == q[:, m], np.minimum(first, max(n, m) + 1), first)
            met = (first <= visits).mean() >= recall
            need, visits = first, visits * 2
        if len(x):
            most = max(most, int(np.sort(need)[int(np.ceil(recall * len(x))) - 1]))
    return most


def _search_leaves(t: pa.Table, k: int, radius: float) -> pa.Table:
    """The k nearest of each row of a group among those with which it shares a leaf (bits of `mask`)."""
    order = np.argsort(t["id"].to_numpy(), kind="stable")
    ids, mask = t["id"].to_numpy()[order], t["mask"].to_numpy()[order]
    x = _matrix(t["v"].to_pylist())[order]
    part, parts = t["part"][0].as_py(), t["parts"][0].as_py()
    one, other, distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for leaf in range(GROUP_LEAVES):
        rows = np.flatnonzero(mask >> leaf & 1)
        if len(rows) > 1:
            i, j, d = _within(x[rows], radius, k, part, parts)
            i, j = ids[rows[i]], ids[rows[j]]
            one, other, distance = _nearest(np.concatenate([one, i, j]), np.concatenate([other, j, i]), np.concatenate([distance, d, d]), k)
    return pa.table({"id": one, "other": other, "distance": distance})


def _near_vectors(heads: DataFrame, total: int, k: int, radius: float, recall: float, dims: int, leaf_rows: int, sample_rows: int) -> DataFrame:
    """(id, other, distance) of the k nearest within the radius; heads: id, v."""
    spark = heads.sparkSession
    share = min(1.0, 1.1 * sample_rows / max(1, total))
    sample = heads.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(sample_rows).toPandas()
    x = _matrix(list(sample["v"])) if len(sample) else np.zeros((0, dims), np.float32)
    tree = fit_tree(x, max(8, int(leaf_rows * len(x) / max(1, total)))) if total > 4 * leaf_rows else Tree(np.zeros((1, dims), np.float32), [np.empty(0, np.int64)])
    leaves = Leaves(tree)
    leaves.visits = _calibrated(leaves, x, radius, k, recall)
    leaves.size = int(np.clip(BLOCK_ROWS // 2 * leaves.count // max(1, total * leaves.visits), 1, GROUP_LEAVES))
    groups = leaves.best(x, leaves.visits) // leaves.size if len(x) else np.zeros((0, 1), np.int64)
    first = np.ones(groups.shape, bool)
    for n in range(1, groups.shape[1]):
        first[:, n] = (groups[:, :n] != groups[:, n : n + 1]).all(1)
    crowd = np.bincount(groups[first], minlength=-(-leaves.count // leaves.size)) * (total / max(1, len(x)))
    leaves.parts = np.maximum(1, np.ceil(crowd / BLOCK_ROWS)).astype(np.int64)  # by the sample: a crowded group is searched by several tasks
    shared = spark.sparkContext.broadcast(leaves)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 2_048):
                c = b.slice(a, 2_048)
                bins = np.sort(t.best(_matrix(c.column(1).to_pylist()), t.visits), axis=1)
                group = bins // t.size
                start = np.ones(group.shape, bool)
                start[:, 1:] = group[:, 1:] != group[:, :-1]
                at = np.flatnonzero(start)
                masks = np.bitwise_or.reduceat((1 << bins % t.size).ravel(), at)
                row, group = at // bins.shape[1], group.ravel()[at]
                again = t.parts[group]
                to = np.repeat(np.arange(len(row)), again)
                part = np.arange(len(to)) - np.repeat(np.cumsum(again) - again, again)
                out = c.take(pa.array(row[to]))
                numbers = [pa.array(n.astype(np.int32)) for n in (masks[to], group[to], part, again[to])]
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), *numbers], names=["id", "v", "mask", "group", "part", "parts"])

    placed = heads.mapInArrow(visit, "id long, v binary, mask int, group int, part int, parts int")
    near = placed.groupBy("group", "part").applyInArrow(lambda t: _search_leaves(t, k, radius), "id long, other long, distance double")
    best = Window.partitionBy("id").orderBy("distance", "other")  # a pair that shares leaves of several groups comes from each
    return near.withColumn("rn", F.dense_rank().over(best)).where(F.col("rn") <= k).drop("rn").dropDuplicates(["id", "other"])


def _radius_search(packed: DataFrame, k: int, radius: float, recall: float, dims: int, leaf_rows: int, sample_rows: int) -> DataFrame:
    """As nearest_vectors with a radius. Equal vectors meet by a digest, so vectors are shuffled to their leaves only."""
    hashed = packed.select("id", F.unhex(F.md5("v")).alias("h"))
    size = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("w"))
    total, copies, rest = size.agg(F.sum(F.least("w", F.lit(k + 1))), F.sum((F.col("w") > k + 1).cast("long")), F.sum(F.when(F.col("w") > k + 1, F.col("w")))).first()
    if not copies:
        return _near_vectors(packed, total or 0, k, radius, recall, dims, leaf_rows, sample_rows)
    rank = Window.partitionBy("h").orderBy("id")
    first = hashed.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k + 1)  # a task sends on k + 1 rows of a vector at most
    first = first.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > k)
    many = cut(first.join(size.where(F.col("w") > k + 1), "h").select("h", "w", F.slice("ids", 1, k).alias("others"), F.col("ids")[k].alias("last")))
    last = many.select("h", "last")
    heads = packed.withColumn("h", F.unhex(F.md5("v"))).join(F.broadcast(last) if copies <= BROADCAST_ROWS else last, "h", "left").where(F.expr("last IS NULL OR id <= last")).select("id", "v")
    found = _near_vectors(heads, total, k, radius, recall, dims, leaf_rows, sample_rows)
    others = lookup(hashed, many, "h", "w", rest, "id").where(F.col("id") > F.col("last"))
    return found.unionByName(others.select("id", F.explode("others").alias("other"), F.lit(0.0).alias("distance")))


def nearest_vectors(df: DataFrame, row_id: str, vector: str, k: int = 10, radius: float | None = None, recall: float = 0.99, dims: int = 64, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For every usable vector the k nearest others: (id, other, distance), squared Euclidean, equal distances by smaller id.

    Usable is a vector of exactly `dims` finite elements that are not all zero; other rows, null ones included, neither ask nor
    answer. `radius` (squared) leaves out neighbours farther away. Ids must be unique. Equal vectors are at distance 0 from each
    other and all of them ask. An empty table gives an empty result; other columns are ignored.

    Method: a k-means tree is fitted on a bounded sample and deepened where the sample is dense, so a leaf holds about `leaf_rows`
    whatever the density; the number of leaves to visit is widened on the sample until `recall` is reached. Each vector is sent to its
    first leaf as a member and to all its leaves as a question, once to each group of neighbouring leaves; leaves are searched by matrix
    products with exact distances for what is near. With a radius every vector is member and question of its few nearest leaves, and the
    leaves are as many as two near vectors need to have one in common: far fewer copies travel, and nothing but digests else. Of equal vectors only the k + 1 smallest ids enter the tree: whatever is near to one of them has its k nearest among
    those. The others take their neighbours, the k smallest ids of their copies, by a lookup that splits hot keys.
    """
    spark = df.sparkSession
    packed = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL").mapInArrow(lambda it: _pack(it, dims), "id long, v binary")
    if radius is not None:
        return _radius_search(packed, k, radius, recall, dims, leaf_rows, sample_rows)
    copies = Window.partitionBy("v").orderBy("id")
    heads = cut(packed.withColumn("rn", F.row_number().over(copies)).where(F.col("rn") <= k + 1))  # a task sends on k + 1 rows of a vector at most
    total = heads.count()
    share = min(1.0, 1.1 * sample_rows / max(1, total))
    sample = heads.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(sample_rows).toPandas()
    x = _matrix(list(sample["v"])) if len(sample) else np.zeros((0, dims), np.float32)
    tree = fit_tree(x, max(8, int(leaf_rows * len(x) / max(1, total)))) if total > 4 * leaf_rows else Tree(np.zeros((1, dims), np.float32), [np.empty(0, np.int64)])
    tree.visits = calibrate(tree, x, k, radius, recall)
    shared = spark.sparkContext.broadcast(tree)  # of at most sample_rows / 4 nodes

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        group, place = t.groups()
        for b in batches:
            for a in range(0, b.num_rows, 2_048):
                c = b.slice(a, 2_048)
                bins = best_bins(t, _matrix(c.column(1).to_pylist()), t.visits)
                row, at = np.nonzero(bins >= 0)
                masks = np.zeros((len(bins), int(group.max()) + 1), np.int32)
                np.add.at(masks, (row, group[bins[row, at]]), np.int32(1) << place[bins[row, at]].astype(np.int32))
                row, to = np.nonzero(masks)
                ends = pa.array(np.searchsorted(row, np.arange(len(bins) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (to, masks[row, to])]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), *lists, pa.array(group[bins[:, 0]], pa.int32()), pa.array(place[bins[:, 0]], pa.int32())], names=["id", "v", "groups", "masks", "at", "place"])

    visits = cut(heads.select("id", "v").mapInArrow(visit, "id long, v binary, groups array<int>, masks array<int>, at int, place int"))
    entries = visits.select("id", "v", "at", "place", F.explode(F.arrays_zip(F.col("groups").alias("group"), F.col("masks").alias("mask"))).alias("x")).select("id", "v", "x.group", "x.mask", F.when(F.col("x.group") == F.col("at"), F.col("place")).otherwise(-1).alias("home"))
    crowd = entries.groupBy("group").count().withColumn("parts", F.ceil(F.col("count") / BLOCK_ROWS).cast("int")).where("parts > 1").select("group", "parts")
    entries = entries.join(F.broadcast(crowd), "group", "left")  # fewer rows than leaves
    own = F.pmod(F.col("id"), F.coalesce("parts", F.lit(1))).cast("int")
    # a member goes to all parts of a crowded group, but asks in one of them
    placed = entries.select("group", "id", "v", "mask", "home", F.explode(F.when(F.col("home") >= 0, F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array(own))).alias("part"), own.alias("own"))
    placed = placed.select("group", "part", "id", "v", "mask", "home", (F.col("part") == F.col("own")).alias("asks"))
    near = placed.groupBy("group", "part").applyInPandas(lambda pdf: _search_group(pdf, k, radius), "id long, other long, distance double")
    best = Window.partitionBy("id").orderBy("distance", "other")
    found = near.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")
    # the remaining copies
    size = packed.groupBy("v").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > k + 1)
    many = cut(size.join(heads.select("v", "id"), "v").groupBy("v", "w").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("others"), F.max("id").alias("last")))
    if many.isEmpty():
        return found
    rest = lookup(packed, many, "v", "w", many.agg(F.sum("w")).first()[0], "id").where(F.col("id") > F.col("last"))
    return found.unionByName(rest.select("id", F.explode("others").alias("other"), F.lit(0.0).alias("distance")))


K, RADIUS = 10, 0.15


def p2_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every memory row, however far."""
    return nearest_vectors(table(spark, folder, "memory_vectors"), "memory_id", "embedding", K).select(F.col("id").alias("memory_id"), F.col("other").alias("neighbor_id"), F.round("distance", 6).alias("distance"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest_vectors(table(spark, folder, "memory_vectors"), "memory_id", "embedding", K, RADIUS)
    return near.select(F.least("id", "other").alias("memory_id_a"), F.greatest("id", "other").alias("memory_id_b")).distinct()


QUERIES = {"p2_found": p2_found, "p2_neighbors": p2_neighbors}

_NEAR = """
WITH u AS (SELECT memory_id, embedding::DOUBLE[] AS e FROM memory_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.memory_id AS a, b.memory_id AS b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM u a JOIN u b ON a.memory_id <> b.memory_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM p)
"""

SQL = {
    "p2_found": _NEAR + "SELECT DISTINCT least(a, b) AS memory_id_a, greatest(a, b) AS memory_id_b FROM k WHERE rn <= 10 AND d <= 0.15",
    "p2_neighbors": _NEAR + "SELECT a AS memory_id, b AS neighbor_id, round(d, 6) AS distance FROM k WHERE rn <= 10",
}
