"""Row numbers, windows of rows and joins that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import CHUNK, chunked, previous_row, running_sums

HOT_SHARE = 256


def _numbered(df: DataFrame, key: str, by: Sequence[str], name: str) -> DataFrame:
    """`df` with the row's number within `key` in the order of `by`, and its chunk."""
    rows = running_sums(chunked(df.withColumn("__one", F.lit(1)), by), by, {"__at": "__one"})
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__w"))
    joined = spread_join(rows, first, key, "__key", "__w", "__at")
    return joined.select(*df.columns, CHUNK, (F.col("__at") - F.col("__first")).alias(name))


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str = "n", descending: Sequence[str] = ()) -> DataFrame:
    """Adds the row's number (from 0) within `key` by `order`, which must be total. Columns in `descending` are numeric and sort from
    large to small. The rows are range-partitioned, so a large key is split; its first number comes from one row per key."""
    signs = {c: f"__neg_{c}" for c in descending}
    lean = df.select("*", *[(-F.col(c)).alias(a) for c, a in signs.items()])
    by = [key, *[signs.get(c, c) for c in order]]
    return _numbered(lean, key, by, name).select(*df.columns, name)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, keyed_key: str, weight: str, row_id: str) -> DataFrame:
    """Left join with a table of one row per key whose `weight` is that key's number of rows. Keys with over one in HOT_SHARE of all
    rows, of which there are fewer than HOT_SHARE, are broadcast; the rest meet by a shuffled join where the rows already served are
    spread by `row_id` (a whole number)."""
    values = [c for c in keyed.columns if c not in (keyed_key, weight)]
    packed = keyed.select(F.col(keyed_key).alias("__k"), F.col(weight).alias("__kw"), F.struct(*values).alias("__v"))
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col("__kw") * HOT_SHARE > total
    hot = packed.where(is_hot).select(F.col("__k").alias("__hk"), F.col("__v").alias("__hv"))
    cold = packed.where(~is_hot).select(F.col("__k").alias("__ck"), F.col("__v").alias("__cv"), F.lit(-1).cast("long").alias("__cs"))
    first = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hk")) & F.col("__hv").isNotNull(), "left")
    salted = first.withColumn("__s", F.when(F.col("__hv").isNull(), F.lit(-1).cast("long")).otherwise(F.abs(F.col(row_id).cast("long"))))
    both = salted.join(cold, F.col(key).eqNullSafe(F.col("__ck")) & (F.col("__s") == F.col("__cs")), "left")
    value = F.coalesce(F.col("__hv"), F.col("__cv"))
    return both.select(*rows.columns, *[value[c].alias(c) for c in values])


def row_windows(df: DataFrame, key: str, order: str | Sequence[str], size: int, fields: Sequence[str]) -> DataFrame:
    """Every complete window of `size` successive rows of a key by `order` (one column or more), which must be total: key, start (number
    of its first row within the key), rows (array of structs of the order's columns and `fields`, in order). Null keys are one key.

    The rows are range-partitioned and numbered in chunks; a window is gathered inside its chunk, and where it crosses the chunk's
    border its other rows come from a list of the following size - 1 rows, one such list per chunk."""
    order = [order] if isinstance(order, str) else list(order)
    by, keep = [key, *order], list(dict.fromkeys([key, *order, *fields]))
    fields = [c for c in keep if c != key]
    rows = _numbered(df.select(*keep), key, by, "__n")
    inside = Window.partitionBy(CHUNK).orderBy(*by)
    row = F.struct(F.col(key).alias("k"), F.struct(*fields).alias("r"))
    placed = rows.select(F.col(key), "__n", CHUNK, *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.collect_list(row).over(inside.rowsBetween(0, size - 1)).alias("__rows"), F.row_number().over(inside).alias("__rn"))
    # the first rows of every chunk, in order: at most size - 1 a chunk; what follows the last of a chunk's is what follows the chunk
    heads = placed.where(F.col("__rn") < size).select(CHUNK, "__rn", F.get("__rows", 0).alias("__row"))
    follow = Window.partitionBy(F.lit(0)).orderBy(CHUNK, "__rn").rowsBetween(1, size - 1)
    after = heads.select(CHUNK, "__rn", F.collect_list("__row").over(follow).alias("__after")).groupBy(CHUNK).agg(F.max_by("__after", "__rn").alias("__after"))
    whole = placed.join(F.broadcast(after), CHUNK, "left")  # at most one row per shuffle partition
    all_ = F.concat("__rows", F.slice("__after", F.lit(1), size - F.size("__rows")))
    full = whole.select(F.col(key), F.col("__n").alias("start"), all_.alias("__all")).where((F.size("__all") == size) & F.element_at("__all", -1)["k"].eqNullSafe(F.col(key)))
    return full.select(key, "start", F.transform("__all", lambda x: x.r).alias("rows"))


def row_chunks(df: DataFrame, key: str, number: str, size: int, fields: Sequence[str], least: int = 2) -> DataFrame:
    """Tumbling chunks of `size` successive rows; the last may be shorter, but not under `least`."""
    return df.groupBy(key, F.floor(F.col(number) / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(number, *fields))).alias("rows")).where(F.size("rows") >= least)


def islands(df: DataFrame, key: str, at: str, row_id: str, gap: float, inclusive: bool) -> DataFrame:
    """Adds `island`: rows of a key, in order of `at`, are cut where the step from one to the next exceeds `gap` (reaches it, if
    inclusive). What folds over neighbours no farther than `gap` may fold each island alone."""
    by = [key, at, row_id]
    before = previous_row(chunked(df, by), by, [key, at])
    step = F.col(at) - F.col(f"prev.{at}")
    new = F.col("prev").isNull() | ~F.col(f"prev.{key}").eqNullSafe(F.col(key)) | (step >= gap if inclusive else step > gap)
    return running_sums(before.withColumn("__new", F.when(new, 1).otherwise(0)), by, {"island": "__new"}).select(*df.columns, "island")
