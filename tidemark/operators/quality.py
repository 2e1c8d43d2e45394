"""Frame quality: verdicts, perceptual-hash leaders, image statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import hamming_hex
from tidemark.session import cut

# Thresholds of the verdicts and of the hash distance.
BLUR, DARK, BRIGHT, SAME_BITS = 60.0, 40.0, 215.0, 6


def verdict(sharpness: Column, luma: Column) -> Column:
    """unreadable, blurry, dark or bright, in this order; null for frames that go on to the search for duplicates."""
    return F.when(sharpness.isNull() | luma.isNull() | F.isnan(sharpness) | F.isnan(luma), "unreadable").when(sharpness < BLUR, "blurry").when(luma < DARK, "dark").when(luma > BRIGHT, "bright")


def verdict_counts(rows: DataFrame, key: str, verdict_col: str = "verdict") -> DataFrame:
    """Per key the numbers of candidates, of usable frames and of each reason to leave one out."""
    of = lambda v: F.sum(F.when(F.col(verdict_col) == v, 1).otherwise(0)).alias(v)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.when(F.col(verdict_col).isNull() | (F.col(verdict_col) == "usable"), 1).otherwise(0)).alias("usable"), *[of(v) for v in ("unreadable", "blurry", "dark", "bright", "duplicate")])


#: A hash of 64 hexadecimal digits in ten bands, in three groups. At most SAME_BITS differing bits leave four bands as they are, and of
#: four bands two are in one group: hashes within the distance share one of the twelve pairs of bands inside groups, some 51 bits.
_BANDS = [(1 + round(i * 64 / 10), round((i + 1) * 64 / 10) - round(i * 64 / 10)) for i in range(SAME_BITS + 4)]
_PAIRS = [(a, b) for group in ((0, 1, 2, 3), (4, 5, 6), (7, 8, 9)) for a in group for b in group if a < b]


def leader_dedup(rows: DataFrame, key: str, order: str, hash_col: str, bits: int = SAME_BITS) -> DataFrame:
    """(key, order, hash, duplicate_of): in the order of `order` (unique whole numbers) a row whose hash is within `bits` of an earlier
    kept one of its key is a duplicate of the first such; others are kept (duplicate_of null). Rows without a valid hash are kept.

    Equal hashes share their fate, so only distinct hashes are compared. Near pairs come from pairs of bands (see
    _PAIRS), of which hashes within the distance share at least one. A hash is decided when its earlier near ones are: kept if
    none of these is kept. Rounds go on until all are decided; they are as many as the longest chain of near hashes.
    """
    if bits > SAME_BITS:
        raise ValueError(f"the bands find distances of up to {SAME_BITS} bits")
    valid = F.coalesce(F.col(hash_col).rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
    lean = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.when(valid, F.col(hash_col)).alias("h"))
    distinct = cut(lean.where("h IS NOT NULL").groupBy("k", "h").agg(F.min("o").alias("o")))
    banded = distinct.select("k", "h", "o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.substring("h", *_BANDS[a]), F.substring("h", *_BANDS[b])).alias("v")) for i, (a, b) in enumerate(_PAIRS)])).alias("b")).select("k", "h", "o", "b.*")
    a, b = banded.alias("a"), banded.alias("b")
    near = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.o") < F.col("b.o")))
    edges = cut(near.where(hamming_hex(F.col("a.h"), F.col("b.h")) <= bits).select(F.col("a.o").alias("earlier"), F.col("b.o").alias("later")).distinct())
    # decided: (o, leader) where leader = o for a kept hash
    open_ = cut(edges.select(F.col("later").alias("o")).distinct())
    decided = cut(edges.select(F.col("earlier").alias("o")).distinct().join(open_, "o", "left_anti").select("o", F.col("o").alias("leader")))
    while not open_.isEmpty():
        known = edges.join(open_.withColumnRenamed("o", "later"), "later").join(decided.withColumnRenamed("o", "earlier"), "earlier", "left")
        state = known.groupBy("later").agg(F.min(F.when(F.col("leader") == F.col("earlier"), F.col("earlier"))).alias("first"), F.max(F.when(F.col("leader").isNull(), F.col("earlier"))).alias("waiting"), F.min(F.when(F.col("leader").isNull(), F.col("earlier"))).alias("undecided"))
        # the first kept one counts, so an undecided hash before it must be decided first
        ready = state.where(F.col("undecided").isNull() | (F.col("first") < F.col("undecided")))
        step = cut(ready.select(F.col("later").alias("o"), F.coalesce("first", "later").alias("leader")))
        decided, open_ = cut(decided.unionByName(step)), cut(open_.join(step, "o", "left_anti"))
    fate = distinct.join(decided, "o", "left").select("k", "h", F.coalesce("leader", "o").alias("leader"))
    return lean.join(fate, ["k", "h"], "left").select(F.col("k").alias(key), F.col("o").alias(order), F.col("h").alias(hash_col), F.when(F.col("leader") != F.col("o"), F.col("leader")).alias("duplicate_of"))


# --- image statistics: raw grey (P5) and colour (P6) images; the codecs of Spark's image source come decoded -------------------------------------------


def decode_raw(content: bytes) -> np.ndarray | None:
    """Luma (0..255, double) of a binary PGM or PPM image; None if it is none."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content or b"")
    if not m or int(m[4]) > 255:
        return None
    w, h, c = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    data = np.frombuffer(content[m.end() :], np.uint8)
    if not w or not h or len(data) < w * h * c:
        return None
    x = data[: w * h * c].reshape(h, w, c).astype(np.float64)
    return x[:, :, 0] if c == 1 else x @ np.array([0.299, 0.587, 0.114])


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average to a smaller grid, nearest to a larger one."""
    h, w = x.shape
    rows = np.minimum((np.arange(height + 1) * h / height).astype(int), h)
    cols = np.minimum((np.arange(width + 1) * w / width).astype(int), w)
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = x.cumsum(0).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], h - 1), np.maximum(rows[1:], np.minimum(rows[:-1], h - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], w - 1), np.maximum(cols[1:], np.minimum(cols[:-1], w - 1) + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None]
    return (sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]) / area


def perceptual_hash(x: np.ndarray, side: int = 16) -> str:
    """Signs of the low frequencies of a cosine transform against their median, as hexadecimal digits."""
    n = side * 4
    g = resized(x, n, n)
    k = np.cos(np.pi / n * (np.arange(n)[None] + 0.5) * np.arange(side)[:, None])
    low = k @ g @ k.T
    return np.packbits(low > np.median(low)).tobytes().hex()


def image_statistics(images: DataFrame) -> DataFrame:
    """(path, sharpness, luma, phash, reduced_luma) of images (path, content): variance of the Laplacian, mean luma, 256-bit hash and
    the 64 x 36 luma grid; nulls for what cannot be decoded. Arrow batches, no shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _statistics((p, decode_raw(bytes(c)) if c is not None else None) for p, c in zip(pdf["path"], pdf["content"]))

    return images.select("path", "content").mapInPandas(work, _STATISTICS)


_STATISTICS = "path string, sharpness double, luma double, phash string, reduced_luma array<int>"


def _statistics(decoded) -> pd.DataFrame:
    out = []
    for path, x in decoded:
        if x is None:
            out.append((path, None, None, None, None))
            continue
        p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x
        out.append((path, float(lap.var()), float(x.mean()), perceptual_hash(x), resized(x, 36, 64).round().astype(int).ravel().tolist()))
    return pd.DataFrame(out, columns=["path", "sharpness", "luma", "phash", "reduced_luma"])


def luma_of(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """Luma of decoded pixels as Spark's image source gives them (blue, green, red, and alpha last); None without an image."""
    if not pixels or height <= 0 or width <= 0:
        return None
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[:, :, 0] if channels == 1 else x[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def pixel_statistics(images: DataFrame) -> DataFrame:
    """image_statistics of decoded images (path, height, width, channels, pixels), as sources.decoded_images reads them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _statistics((p, luma_of(bytes(d) if d is not None else b"", h, w, c)) for p, h, w, c, d in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["pixels"]))

    return images.select("path", "height", "width", "channels", "pixels").mapInPandas(work, _STATISTICS)


def normalised_images(images: DataFrame, short: int = 512, square: int | None = None) -> DataFrame:
    """(path, height, width, pixels) in red, green, blue, with the shorter side `short` and the proportions kept, or a centred square of
    side `square`. Images that could not be decoded have null pixels; sizes are by area average, larger ones by the nearest pixel."""

    def one(d, h: int, w: int, c: int):
        if luma_of(d, h, w, c) is None:
            return None, None, None
        x = np.frombuffer(d, np.uint8).reshape(h, w, c)
        x = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]
        if square:
            n = min(h, w)
            a, b = (h - n) // 2, (w - n) // 2
            x, nh, nw = x[a : a + n, b : b + n], square, square
        else:
            nh, nw = (int(h * short / w), short) if w < h else (short, int(w * short / h))
        planes = [resized(x[:, :, i].astype(np.float64), nh, nw).round().clip(0, 255).astype(np.uint8) for i in range(3)]
        return nh, nw, np.stack(planes, axis=2).tobytes()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *one(bytes(d) if d is not None else b"", h, w, c)) for p, h, w, c, d in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["pixels"])]
            yield pd.DataFrame(rows, columns=["path", "height", "width", "pixels"]).astype({"height": "Int32", "width": "Int32"})

    return images.select("path", "height", "width", "channels", "pixels").mapInPandas(work, "path string, height int, width int, pixels binary")


def frame_verdicts(frames: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, path, sharpness, luma, phash, verdict, duplicate_of) of frames (key, order, path, content), `order` unique whole
    numbers and `path` unique: the verdicts in turn, then duplicates among the frames that pass these; the rest are usable."""
    rows = cut(frames.select(key, order, "path").join(image_statistics(frames).select("path", "sharpness", "luma", "phash"), "path").withColumn("verdict", verdict(F.col("sharpness"), F.col("luma"))))
    return with_duplicates(rows, key, order, "phash").select(key, order, "path", "sharpness", "luma", "phash", "verdict", "duplicate_of")


def with_duplicates(rows: DataFrame, key: str, order: str, hash_col: str) -> DataFrame:
    """`rows` with their `verdict` completed, and duplicate_of: those without a verdict enter the search for duplicates among their key's,
    in the order of `order`; what is found there is a duplicate, the rest is usable."""
    fate = leader_dedup(rows.where("verdict IS NULL"), key, order, hash_col).select(F.col(order).alias("__o"), "duplicate_of")
    last = F.coalesce("verdict", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("usable"))
    return rows.join(fate, F.col(order) == F.col("__o"), "left").drop("__o").withColumn("verdict", last)


def mean_luma_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two luma grids, rounded."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a), 6)
