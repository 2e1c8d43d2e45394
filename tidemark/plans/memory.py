"""Queries over the vector memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import accepted_fact, card_status, nonblank
from tidemark.operators import memory as M
from tidemark.session import table

#: The vector that single searches ask with: a fixed direction.
QUERY = [((i * 37) % 64 - 31.5) / 150 for i in range(64)]


def _memory(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with their vectors: the vector table's rows are unique by memory_id and so are the memory's."""
    vectors = table(spark, folder, "memory_vectors").select("memory_id", "embedding")
    return table(spark, folder, "memory_rows").join(vectors, "memory_id")


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled vectors as a memory of ten sources with overlapping ranges."""
    at = (F.col("vec_id") % 100).cast("double")
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("label").cast("string").alias("video_id"), F.array(at, at + 5).alias("time_range"), "embedding")


def knn_topk(spark, folder):
    return M.search(_store(spark, folder), QUERY, 10).select("ordinal", "video_id", F.round("distance", 9).alias("distance"), F.round("similarity", 9).alias("similarity"))


def knn_topk_video(spark, folder):
    return M.search(_store(spark, folder), QUERY, 10, key="video_id", key_value="3").select("ordinal", F.round("distance", 9).alias("distance"))


def knn_topk_time(spark, folder):
    return M.search(_store(spark, folder), QUERY, 10, time_range=(10.0, 20.0)).select("ordinal", "time_range", F.round("distance", 9).alias("distance"))


def knn_memory(spark, folder):
    """The same search over the real memory: rows joined to their vectors after the top-k, so rows are not shuffled for it."""
    found = M.search(table(spark, folder, "memory_vectors").select("memory_id", "embedding"), QUERY, 20, ordinal="memory_id")
    return table(spark, folder, "memory_rows").select("memory_id", "block_id", "summary").join(F.broadcast(found.select("memory_id", "distance")), "memory_id").select("memory_id", "block_id", "summary", F.round("distance", 9).alias("distance"))


def knn_batch(spark, folder):
    """Every row whose id is divisible by 100 against all rows: the stated query set."""
    rows = table(spark, folder, "memory_vectors").select("memory_id", "embedding")
    return M.search_all(rows, rows.where("memory_id % 100 = 0"), "memory_id", "embedding", 5, 64).select("query_id", "memory_id", "rank", F.round("distance", 6).alias("distance"))


def vector_batch_errors(spark, folder):
    return M.batch_errors(table(spark, folder, "memory_vectors"), "embedding", 64, "video_id").select("memory_id", F.array_join("errors", "; ").alias("errors"))


def topics_topk(spark, folder):
    return M.top_topics(table(spark, folder, "memory_rows"), k=10)


def topic_counts(spark, folder):
    return M.top_topics(table(spark, folder, "memory_rows"))


def accepted_decisions(spark, folder):
    return M.accepted_items(table(spark, folder, "memory_rows"), "decisions", "decision")


def accepted_tasks(spark, folder):
    return M.accepted_items(table(spark, folder, "memory_rows"), "tasks", "task")


def video_summary(spark, folder):
    return M.video_summaries(table(spark, folder, "memory_rows")).withColumn("topics", F.array_join("topics", "; "))


def video_rollup(spark, folder):
    return M.video_rollups(table(spark, folder, "memory_rows"))


def acceptance_split(spark, folder):
    rows = table(spark, folder, "memory_rows").select("memory_id", "verification_status", "accepted_as_fact", *[F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), F.coalesce(F.col(f"unvalidated_{c}"), F.array().cast("array<string>"))).alias(c) for c in M.SPLIT])
    return M.split_by_acceptance(rows).select("memory_id", "accepted_as_fact", *M.SPLIT, *[f"unvalidated_{c}" for c in M.SPLIT])


def searchable_texts(spark, folder):
    none = F.array().cast("array<string>")
    ok = accepted_fact(F.col("accepted_as_fact"), F.col("verification_status"))
    topics = F.concat(F.coalesce(F.col("topics"), none), F.coalesce(F.col("unvalidated_topics"), none))
    text = M.searchable_text(F.col("summary"), topics, F.filter(F.array("intent"), lambda x: x.isNotNull()), F.coalesce(F.col("decisions"), none), F.coalesce(F.col("tasks"), none), ok)
    return table(spark, folder, "memory_rows").select("memory_id", text.alias("searchable_text")).where(nonblank(F.col("searchable_text")))


def list_events(spark, folder):
    return M.list_events(table(spark, folder, "memory_rows"), 25).select("memory_id", "video_id", "block_id")


def get_event(spark, folder):
    rows = table(spark, folder, "memory_rows")
    return M.list_events(rows.where("block_id = 'ctx_0003'"), 1, "P0000_00").select("memory_id", "video_id", "block_id", "summary")


def memory_videos(spark, folder):
    return table(spark, folder, "memory_rows").select("video_id").distinct()


def keyed_replace(spark, folder):
    """Videos of split test are delivered anew (their even rows only); all other videos' rows stay."""
    rows = table(spark, folder, "memory_rows").select("memory_id", "video_id", "block_id")
    keys = table(spark, folder, "videos").where("split = 'test'").select("video_id")
    return M.replace_keys(rows, rows.where("memory_id % 2 = 0").withColumn("block_id", F.concat(F.col("block_id"), F.lit("_v2"))), "video_id", keys)


def anti_retained(spark, folder):
    rows = table(spark, folder, "memory_rows").select("memory_id", "video_id")
    return rows.where("video_id <> 'P0000_00'")


def resume_pending(spark, folder):
    return M.pending_keys(table(spark, folder, "videos"), table(spark, folder, "segments"), "video_id")


def latest_delivery(spark, folder):
    return M.latest_deliveries(table(spark, folder, "memory_rows").select("memory_id", "video_id", "block_id", "source_type"), ["video_id", "block_id"], "memory_id")


def evidence_cards(spark, folder):
    """The card of every memory row: range, observation, status and acceptance."""
    t = F.col("time_range")
    two = F.size(t) == 2
    status = card_status(F.col("verification_status"), F.col("source_type"))
    return table(spark, folder, "memory_rows").select("memory_id", "video_id", F.when(two, F.get(t, 0)).alias("start_sec"), F.when(two, F.get(t, 1)).alias("end_sec"), F.coalesce("visual_caption", F.lit("")).alias("observation"), status.alias("verification_status"), accepted_fact(F.col("accepted_as_fact"), status).alias("accepted"))


def evidence_status(spark, folder):
    """The answer to one question: the 20 nearest observations in a time range and what they establish."""
    found = M.search(_memory(spark, folder), QUERY, 20, ordinal="memory_id", time_range=(0.0, 120.0))
    ok = accepted_fact(F.col("accepted_as_fact"), F.col("verification_status"))
    one = found.agg(F.count(F.lit(1)).alias("cards"), F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0)).alias("accepted_cards"))
    return one.select("cards", "accepted_cards", F.when(F.col("cards") > 0, "ok").otherwise("no_matches").alias("status"), F.when(F.col("accepted_cards") > 0, "supported_by_accepted_evidence").otherwise("insufficient_evidence").alias("answer_status"))


QUERIES = {f.__name__: f for f in (knn_topk, knn_topk_video, knn_topk_time, knn_memory, knn_batch, vector_batch_errors, topics_topk, topic_counts, accepted_decisions, accepted_tasks, video_summary, video_rollup, acceptance_split, searchable_texts, list_events, get_event, memory_videos, keyed_replace, anti_retained, resume_pending, latest_delivery, evidence_cards, evidence_status)}

_Q = "[" + ", ".join(f"({x!r})::FLOAT" for x in QUERY) + "]"
_D = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_STORE = f"WITH m AS (SELECT vec_id AS ordinal, CAST(label AS VARCHAR) AS video_id, [(vec_id % 100)::DOUBLE, (vec_id % 100 + 5)::DOUBLE] AS time_range, {_D.format(a='embedding', b=_Q)} AS d FROM embeddings) "
_OK = "(accepted_as_fact IS NOT DISTINCT FROM true AND verification_status IS NOT DISTINCT FROM 'accepted_independent_evidence')"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64"

SQL = {
    "knn_topk": _STORE + "SELECT ordinal, video_id, round(d, 9) AS distance, round(1 / (1 + d), 9) AS similarity FROM m ORDER BY d, ordinal LIMIT 10",
    "knn_topk_video": _STORE + "SELECT ordinal, round(d, 9) AS distance FROM m WHERE video_id = '3' ORDER BY d, ordinal LIMIT 10",
    "knn_topk_time": _STORE + "SELECT ordinal, time_range, round(d, 9) AS distance FROM m WHERE time_range[1] <= 20 AND 10 <= time_range[2] ORDER BY d, ordinal LIMIT 10",
    "knn_memory": f"WITH v AS (SELECT memory_id, {_D.format(a='embedding', b=_Q)} AS d FROM memory_vectors WHERE {_USABLE} ORDER BY d, memory_id LIMIT 20) SELECT memory_id, block_id, summary, round(d, 9) AS distance FROM v JOIN memory_rows USING (memory_id)",
    "knn_batch": f"WITH u AS (SELECT memory_id, embedding AS e FROM memory_vectors WHERE {_USABLE}), p AS (SELECT a.memory_id AS query_id, b.memory_id, {_D.format(a='a.e', b='b.e')} AS d FROM u a JOIN u b ON a.memory_id <> b.memory_id WHERE a.memory_id % 100 = 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, memory_id) AS INTEGER) AS rank FROM p) SELECT query_id, memory_id, rank, round(d, 6) AS distance FROM k WHERE rank <= 5",
    "vector_batch_errors": "SELECT memory_id, concat_ws('; ', CASE WHEN embedding IS NULL OR len(embedding) <> 64 THEN 'wrong dimension' END, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' END, CASE WHEN video_id IS NULL THEN 'no key' END) AS errors FROM memory_vectors WHERE embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR video_id IS NULL",
    "topics_topk": "WITH e AS (SELECT memory_id, unnest(topics) AS topic, unnest(range(len(topics))) AS p FROM memory_rows WHERE accepted_as_fact) SELECT topic, count(*) AS count FROM e GROUP BY topic ORDER BY count(*) DESC, min((memory_id, p)) LIMIT 10",
    "topic_counts": "SELECT topic, count(*) AS count FROM (SELECT unnest(topics) AS topic FROM memory_rows WHERE accepted_as_fact) GROUP BY topic",
    "accepted_decisions": "SELECT memory_id, video_id, block_id, time_range, CAST(unnest(range(len(decisions))) AS INTEGER) AS position, unnest(decisions) AS decision FROM memory_rows WHERE accepted_as_fact",
    "accepted_tasks": "SELECT memory_id, video_id, block_id, time_range, CAST(unnest(range(len(tasks))) AS INTEGER) AS position, unnest(tasks) AS task FROM memory_rows WHERE accepted_as_fact",
    "video_summary": """
WITH c AS (SELECT video_id, sum(CASE WHEN accepted_as_fact THEN coalesce(len(decisions), 0) ELSE 0 END)::BIGINT AS decisions, sum(CASE WHEN accepted_as_fact THEN coalesce(len(tasks), 0) ELSE 0 END)::BIGINT AS tasks, count(*) FILTER (accepted_as_fact IS DISTINCT FROM true) AS unvalidated_blocks, count(*) AS blocks,
  coalesce(left(string_agg(speech_text, ' ' ORDER BY memory_id) FILTER (speech_text <> ''), 2000), '') AS transcript_head FROM memory_rows GROUP BY video_id),
t AS (SELECT video_id, string_agg(topic, '; ' ORDER BY encode(topic)) AS topics FROM (SELECT DISTINCT video_id, unnest(topics) AS topic FROM memory_rows WHERE accepted_as_fact) GROUP BY video_id)
SELECT video_id, coalesce(topics, '') AS topics, decisions, tasks, unvalidated_blocks, blocks, transcript_head FROM c LEFT JOIN t USING (video_id)""",
    "video_rollup": """
WITH l AS (SELECT memory_id, video_id, 'd' AS what, unnest(range(len(decisions))) AS p, unnest(decisions) AS x FROM memory_rows WHERE accepted_as_fact UNION ALL SELECT memory_id, video_id, 't', unnest(range(len(tasks))), unnest(tasks) FROM memory_rows WHERE accepted_as_fact),
g AS (SELECT video_id, list(x ORDER BY memory_id, p) FILTER (what = 'd') AS d, list(x ORDER BY memory_id, p) FILTER (what = 't') AS t FROM l GROUP BY video_id),
o AS (SELECT video_id, list(topic ORDER BY encode(topic)) AS topics FROM (SELECT DISTINCT video_id, unnest(topics) AS topic FROM memory_rows WHERE accepted_as_fact) GROUP BY video_id),
c AS (SELECT video_id, count(*) FILTER (accepted_as_fact IS DISTINCT FROM true) AS unvalidated_blocks, count(*) AS blocks, coalesce(string_agg(speech_text, ' ' ORDER BY memory_id) FILTER (speech_text <> ''), '') AS transcript FROM memory_rows GROUP BY video_id)
SELECT video_id, coalesce(topics, []) AS topics, coalesce(d, []) AS decisions, coalesce(t, []) AS tasks, unvalidated_blocks, blocks, transcript FROM c LEFT JOIN o USING (video_id) LEFT JOIN g USING (video_id)""",
    "acceptance_split": f"WITH x AS (SELECT memory_id, {_OK} AS ok, "
    + ", ".join(f"list_concat(coalesce({c}, []), coalesce(unvalidated_{c}, [])) AS {c[:2]}_" for c in M.SPLIT)
    + " FROM memory_rows) SELECT memory_id, ok AS accepted_as_fact, "
    + ", ".join(f"CASE WHEN ok THEN {c[:2] + '_'} ELSE [] END AS {c}, CASE WHEN ok THEN [] ELSE {c[:2] + '_'} END AS unvalidated_{c}" for c in M.SPLIT)
    + " FROM x",
    "searchable_texts": f"""
WITH x AS (SELECT memory_id, {_OK} AS ok, summary, list_concat(coalesce(topics, []), coalesce(unvalidated_topics, [])) AS t, intent, coalesce(decisions, []) AS d, coalesce(tasks, []) AS k FROM memory_rows),
b AS (SELECT memory_id, ok, concat_ws(' | ', CASE WHEN summary <> '' THEN summary END, CASE WHEN len(t) > 0 THEN 'Topics: ' || array_to_string(t, ', ') END, CASE WHEN intent IS NOT NULL THEN 'Entities: ' || intent END, CASE WHEN ok AND len(d) > 0 THEN 'Decisions: ' || array_to_string(d, ' | ') END, CASE WHEN ok AND len(k) > 0 THEN 'Tasks: ' || array_to_string(k, ' | ') END) AS s FROM x)
SELECT memory_id, CASE WHEN ok THEN s ELSE 'UNVALIDATED MODEL HYPOTHESIS | ' || s END AS searchable_text FROM b WHERE s <> ''""",
    "list_events": "SELECT memory_id, video_id, block_id FROM memory_rows ORDER BY memory_id LIMIT 25",
    "get_event": "SELECT memory_id, video_id, block_id, summary FROM memory_rows WHERE video_id = 'P0000_00' AND block_id = 'ctx_0003' ORDER BY memory_id LIMIT 1",
    "memory_videos": "SELECT DISTINCT video_id FROM memory_rows",
    "keyed_replace": "SELECT memory_id, video_id, CASE WHEN video_id IN (SELECT video_id FROM videos WHERE split = 'test') THEN block_id || '_v2' ELSE block_id END AS block_id FROM memory_rows WHERE video_id NOT IN (SELECT video_id FROM videos WHERE split = 'test') OR memory_id % 2 = 0",
    "anti_retained": "SELECT memory_id, video_id FROM memory_rows WHERE video_id <> 'P0000_00'",
    "resume_pending": "SELECT DISTINCT video_id FROM videos WHERE video_id NOT IN (SELECT video_id FROM segments)",
    "latest_delivery": "SELECT memory_id, video_id, block_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY video_id, block_id ORDER BY memory_id DESC) AS rn FROM memory_rows) WHERE rn = 1",
    "evidence_cards": f"WITH s AS (SELECT *, CASE WHEN verification_status <> '' THEN verification_status WHEN source_type = 'model' THEN 'unvalidated_model_hypothesis' ELSE 'unvalidated_or_unknown' END AS st FROM memory_rows) SELECT memory_id, video_id, CASE WHEN len(time_range) = 2 THEN time_range[1] END AS start_sec, CASE WHEN len(time_range) = 2 THEN time_range[2] END AS end_sec, coalesce(visual_caption, '') AS observation, st AS verification_status, accepted_as_fact IS NOT DISTINCT FROM true AND st = 'accepted_independent_evidence' AS accepted FROM s",
    "evidence_status": f"WITH v AS (SELECT r.*, {_D.format(a='embedding', b=_Q)} AS d FROM memory_rows r JOIN memory_vectors v USING (memory_id) WHERE {_USABLE} AND len(time_range) = 2 AND isfinite(time_range[1]) AND isfinite(time_range[2]) AND time_range[2] >= time_range[1] AND time_range[1] <= 120 AND 0 <= time_range[2]), k AS (SELECT * FROM v ORDER BY d, memory_id LIMIT 20), o AS (SELECT count(*) AS cards, count(*) FILTER ({_OK}) AS accepted_cards FROM k) SELECT cards, accepted_cards, CASE WHEN cards > 0 THEN 'ok' ELSE 'no_matches' END AS status, CASE WHEN accepted_cards > 0 THEN 'supported_by_accepted_evidence' ELSE 'insufficient_evidence' END AS answer_status FROM o",
}
