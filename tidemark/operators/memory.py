"""Vector memory: exact filtered nearest neighbours, keyed replacement, rollups over accepted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import accepted_fact, accepted_flag, nonblank, overlaps_closed, similarity, squared_distance
from tidemark.operators.intervals import finite, valid_range
from tidemark.operators.numbering import numbered
from tidemark.operators.ordered import chunked, running_sums
from tidemark.session import shuffle_partitions


def usable_vector(c: Column, dims: int) -> Column:
    """Of the store's dimension and finite throughout."""
    return F.coalesce((F.size(c) == dims) & F.forall(c, lambda x: finite(x)), F.lit(False))


def batch_errors(df: DataFrame, vector: str, dims: int, key: str, key_value: str | None = None) -> DataFrame:
    """Rows that a store would refuse, with the names of the rules they break (column errors)."""
    v = F.col(vector)
    rules = [F.when(v.isNull() | (F.size(v) != dims), "wrong dimension"), F.when(F.coalesce(F.exists(v, lambda x: ~finite(x)), F.lit(False)), "not finite"), F.when(F.col(key).isNull(), "no key")]
    if key_value is not None:
        rules.append(F.when(F.col(key) != key_value, "row of another key"))
    return df.withColumn("errors", F.array_compact(F.array(*rules))).where(F.size("errors") > 0)


def search(memory: DataFrame, query: list[float], k: int, ordinal: str = "ordinal", vector: str = "embedding", key: str | None = None, key_value: str | None = None, time_range: tuple[float, float] | None = None) -> DataFrame:
    """The k rows nearest to `query`, with distance (squared Euclidean) and similarity; ties by ordinal.

    Filters apply before the ranking: the key's equality, and closed overlap of time_range with the requested range, which leaves
    out rows without a valid range. Vectors of another dimension or with elements that are not finite never match. k = 0 gives no
    row, a k beyond the number of rows all of them. One filtered scan and a top-k of k rows per task.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    df = memory.where(usable_vector(F.col(vector), len(query)))
    if key_value is not None:
        df = df.where(F.col(key) == key_value)
    if time_range is not None:
        t = F.col("time_range")
        df = df.where(valid_range(t) & overlaps_closed(F.get(t, 0), F.get(t, 1), F.lit(float(time_range[0])), F.lit(float(time_range[1]))))
    q = F.lit([float(x) for x in query]).cast("array<float>")
    ranked = df.withColumn("distance", squared_distance(F.col(vector), q)).withColumn("similarity", similarity(F.col("distance")))
    return ranked.orderBy("distance", ordinal).limit(k)


#: Rows that one part of a batch search holds in memory (64 MB of 64 floats); every query goes to every part.
PART_ROWS = 262_144


def search_all(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int, dims: int) -> DataFrame:
    """The k nearest rows of every query, itself left out: (query_id, row_id, distance); ties by the smaller id. Exact.

    Both tables have unique ids in `row_id`. The queries are a stated set that is small beside the rows. One shuffled job: rows are
    spread over parts of at most some PART_ROWS, each query is sent to each part, and a part's task holds its rows while queries stream
    by in blocks, k candidates each. Nothing is collected or broadcast.
    """
    spark = rows.sparkSession
    ready = lambda df: df.where(usable_vector(F.col(vector), dims)).select(F.col(row_id).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    parts = max(shuffle_partitions(spark), -(-rows.count() // PART_ROWS))
    held = ready(rows).select("id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    asked = ready(queries).select("id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    streams = held.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "asks")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, ids, x = None, [], np.empty(0, np.int64), np.empty((0, dims), np.float32)
        for pdf in batches:
            for p, group in pdf.groupby("part", sort=True):
                if p != part:
                    part, held, ids = p, [], None
                own, q = group[~group["asks"]], group[group["asks"]]
                if len(own):
                    held.append((own["id"].to_numpy(), np.stack(own["v"].to_numpy()).astype(np.float32)))
                if not len(q):
                    continue
                if ids is None:  # rows come before queries
                    ids = np.concatenate([a for a, _ in held]) if held else np.empty(0, np.int64)
                    x = np.concatenate([a for _, a in held]) if held else np.empty((0, dims), np.float32)
                    held = []
                if len(ids):
                    yield _k_nearest(q["id"].to_numpy(), np.stack(q["v"].to_numpy()).astype(np.float32), ids, x, k, row_id)

    found = streams.mapInPandas(near, f"query_id long, {row_id} long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", row_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _k_nearest(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, row_id: str) -> pd.DataFrame:
    """The k nearest of x for each q by exact distance, ties by the smaller id, itself left out."""
    found, step = [], max(1, 4_000_000 // len(ids))
    square = (x**2).sum(1)[None]
    for a in range(0, len(qid), step):
        d = np.maximum((q[a : a + step] ** 2).sum(1)[:, None] + square - 2 * q[a : a + step] @ x.T, 0)
        d[qid[a : a + step, None] == ids[None]] = np.inf
        edge = np.partition(d, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        i, j = np.nonzero(np.isfinite(d) & (d <= np.where(np.isfinite(edge), edge * 1.001 + 1e-4, np.inf)[:, None]))
        exact = ((q[a + i].astype(np.float64) - x[j].astype(np.float64)) ** 2).sum(1)
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append(pd.DataFrame({"query_id": qid[a + i[first]], row_id: ids[j[first]], "distance": exact[first]}))
    return pd.concat(found)


def replace_keys(store: DataFrame, new: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The store with all rows of `keys` (one column, `key`) replaced by `new`; keys without new rows are deleted. Rows of other
    keys stay as they are; rows of `new` for other keys are an error of the caller and are left out."""
    gone = keys.select(key).distinct()
    return store.join(gone, key, "left_anti").unionByName(new.join(gone, key, "left_semi"), allowMissingColumns=True)


def pending_keys(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys without an artifact yet (resume)."""
    return wanted.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


SPLIT = ("topics", "decisions", "tasks")


def split_by_acceptance(blocks: DataFrame) -> DataFrame:
    """Topics, decisions and tasks stay in their columns for accepted blocks and move to unvalidated_* for all others; null is empty."""
    ok = accepted_fact(F.col("accepted_as_fact"), F.col("verification_status"))
    none = F.array().cast("array<string>")
    full = {c: F.coalesce(F.col(c), none) for c in SPLIT}
    return blocks.withColumns({c: F.when(ok, full[c]).otherwise(none) for c in SPLIT} | {f"unvalidated_{c}": F.when(ok, none).otherwise(full[c]) for c in SPLIT} | {"accepted_as_fact": ok})


def searchable_text(summary: Column, topics: Column, entities: Column, decisions: Column, tasks: Column, accepted: Column) -> Column:
    """Summary, topics and entities, and of accepted blocks decisions and tasks, in one line; other blocks say that they are
    hypotheses; empty when there is nothing to say."""
    part = lambda name, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, sep)))
    body = F.concat_ws(" | ", F.when(summary != "", summary), part("Topics", topics, ", "), part("Entities", entities, ", "), F.when(accepted, part("Decisions", decisions, " | ")), F.when(accepted, part("Tasks", tasks, " | ")))
    return F.when(body == "", "").when(accepted, body).otherwise(F.concat(F.lit("UNVALIDATED MODEL HYPOTHESIS | "), body))


def top_topics(rows: DataFrame, ordinal: str = "memory_id", k: int | None = None) -> DataFrame:
    """(topic, count) over rows flagged accepted, most frequent first, ties by first appearance."""
    each = rows.where(accepted_flag(F.col("accepted_as_fact"))).select(F.col(ordinal).alias("o"), F.posexplode("topics").alias("p", "topic"))
    counted = each.groupBy("topic").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("o", "p")).alias("first")).orderBy(F.desc("count"), "first")
    return (counted if k is None else counted.limit(k)).select("topic", "count")


def accepted_items(rows: DataFrame, field: str, name: str, ordinal: str = "memory_id") -> DataFrame:
    """Every entry of `field` (decisions or tasks) of rows flagged accepted, with its place in time; order: ordinal, position."""
    return rows.where(accepted_flag(F.col("accepted_as_fact"))).select(F.col(ordinal), "video_id", "block_id", "time_range", F.posexplode(field).alias("position", name))


def video_summaries(rows: DataFrame, ordinal: str = "memory_id", prompt_chars: int = 2000) -> DataFrame:
    """One row per video: sorted distinct accepted topics, numbers of accepted decisions and tasks, of blocks and of blocks left out,
    and the first `prompt_chars` characters of the speech in order (what a summary prompt takes).

    A video's whole transcript is never gathered: running lengths name the rows that begin within the first `prompt_chars`
    characters, and only those are collected.
    """
    ok = accepted_flag(F.col("accepted_as_fact"))
    size = lambda c: F.when(ok, F.coalesce(F.size(c), F.lit(0))).otherwise(0)
    base = rows.select("video_id", size("decisions").alias("d"), size("tasks").alias("t"), F.when(ok, 0).otherwise(1).alias("u"))
    counts = base.groupBy("video_id").agg(F.sum("d").alias("decisions"), F.sum("t").alias("tasks"), F.sum("u").alias("unvalidated_blocks"), F.count(F.lit(1)).alias("blocks"))
    topics = rows.where(ok).select("video_id", F.explode("topics").alias("topic")).distinct().groupBy("video_id").agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    spoken = rows.where(F.length("speech_text") > 0).select("video_id", ordinal, "speech_text", (F.length("speech_text") + 1).alias("len"))
    order = ["video_id", ordinal]
    summed = running_sums(chunked(spoken, order), order, {"upto": "len"})
    first = summed.groupBy("video_id").agg(F.min(F.col("upto") - F.col("len")).alias("base"))
    near = summed.join(first, "video_id").where(F.col("upto") - F.col("len") - F.col("base") < prompt_chars)
    text = near.groupBy("video_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "speech_text"))), lambda s: s.speech_text), " "), 1, prompt_chars).alias("transcript_head"))
    none = F.array().cast("array<string>")
    return counts.join(topics, "video_id", "left").join(text, "video_id", "left").select("video_id", F.coalesce("topics", none).alias("topics"), "decisions", "tasks", "unvalidated_blocks", "blocks", F.coalesce("transcript_head", F.lit("")).alias("transcript_head"))


def video_rollups(rows: DataFrame, ordinal: str = "memory_id") -> DataFrame:
    """The whole rollup of each video: its distinct accepted topics in order, accepted decisions and tasks as they come, the number of
    blocks and of those left out, and all its speech in order. Such a row is as large as what it lists, which is what it is asked for;
    `video_summaries` has numbers and what a prompt takes instead. Null and empty speech is left out, nulls in lists stay."""
    ok = accepted_flag(F.col("accepted_as_fact"))
    none = F.array().cast("array<string>")
    mine = lambda c: F.when(ok, F.coalesce(F.col(c), none)).otherwise(none)
    each = F.struct(F.col(ordinal).alias("o"), mine("topics").alias("topics"), mine("decisions").alias("decisions"), mine("tasks").alias("tasks"), F.when(F.length("speech_text") > 0, F.col("speech_text")).alias("speech"))
    all_ = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(each)).alias("b"), F.sum(F.when(ok, 0).otherwise(1)).alias("unvalidated_blocks"), F.count(F.lit(1)).alias("blocks"))
    joined = lambda c: F.flatten(F.transform("b", lambda x: x[c]))
    return all_.select("video_id", F.array_sort(F.array_distinct(joined("topics"))).alias("topics"), joined("decisions").alias("decisions"), joined("tasks").alias("tasks"), "unvalidated_blocks", "blocks", F.concat_ws(" ", F.transform("b", lambda x: x.speech)).alias("transcript"))


def list_events(rows: DataFrame, limit: int, video_id: str | None = None, ordinal: str = "memory_id") -> DataFrame:
    """The first `limit` rows in order of insertion."""
    return (rows if video_id is None else rows.where(F.col("video_id") == video_id)).orderBy(ordinal).limit(limit)


def latest_deliveries(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of rows delivered again under the same keys the one with the largest ordinal."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def index_rows(semantic: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memory rows, orphans): semantic blocks with text joined to their context blocks on (video_id, block_id); orphans are blocks
    with text but without a context block, an integrity error that the caller must look at."""
    worded = semantic.where(nonblank(F.col("searchable_text")))
    keys = ["video_id", "block_id"]
    return worded.join(context, keys), worded.join(context, keys, "left_anti")


def numbered_memory(rows: DataFrame, ordinal: str) -> DataFrame:
    return numbered(rows, "video_id", [ordinal], "position")
