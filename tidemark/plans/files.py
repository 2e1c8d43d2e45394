"""Queries that go through files (written below the session's shared folder and read back), and over small contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import adapters, sources
from tidemark.functions.columns import hamming_hex
from tidemark.operators import contracts as C
from tidemark.operators import hypotheses as H
from tidemark.operators import memory as M
from tidemark.operators import windows as W
from tidemark.operators.ordered import chunked, previous_row
from tidemark.operators.quality import mean_luma_delta
from tidemark.plans.memory import QUERY, _store
from tidemark.plans.windows import _F, _frames
from tidemark.session import shared_folder, table
from tidemark.sources import sinks


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def frame_map_files(spark, folder):
    """Frame maps as whole-file JSON documents, one a video; their fixed frames by time."""
    c = table(spark, folder, "captions").where("frame_id IS NOT NULL AND source_path IS NOT NULL AND timestamp_sec IS NOT NULL AND NOT isnan(timestamp_sec)")
    one = c.groupBy("video_id", "source_path").agg(F.min("timestamp_sec").alias("t"))
    docs = one.groupBy("video_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source_path", F.struct(F.col("t").alias("timestamp_sec"), F.lit("fixed").alias("sampling")))))).alias("j"))
    place = _place(spark, "maps")
    docs.select(F.to_json(F.struct("video_id", "j"))).write.option("maxRecordsPerFile", 1).text(place)
    read = sources.json_documents(spark, place, "video_id string, j string")
    return sources.frame_map(read, "j").select("video_id", "source_path", "n", "timestamp_sec")


def reference_files(spark, folder):
    """Segments as reference files with a header, read back with their text as it stands."""
    place = _place(spark, "references")
    s = table(spark, folder, "segments").where("text IS NOT NULL AND text <> ''").select("segment_id", "video_id", F.concat(F.lit('"'), F.regexp_replace("text", r"[\r\n]", " "), F.lit('", \\')).alias("label"))
    s.write.csv(place, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return sources.reference_csv(spark, place, ["segment_id", "label"]).select(F.col("segment_id").cast("long").alias("segment_id"), "video_id", "label")


def probe_files(spark, folder):
    """Probe results of every video, with a stream that starts late for each fifth."""
    place = _place(spark, "probes")
    v = table(spark, folder, "videos").withColumn("n", F.length("video_id") + F.ascii(F.substring("video_id", -1, 1)))
    stream = lambda kind, start: F.struct(F.lit(kind).alias("codec_type"), start.alias("start_time"), F.col("source_duration_seconds").cast("string").alias("duration"))
    v.select("video_id", F.array(stream("video", F.lit("0.000000")), stream("audio", F.when(F.col("n") % 5 == 0, "0.021333").otherwise("0"))).alias("streams")).write.json(place)
    return sources.media_probes(spark, place)


def store_round_trip(spark, folder):
    """Vectors in a keyed store: two adds, a replaced video, a deleted one, and a compaction."""
    store = sinks.VideoStore(spark, _place(spark, "store"), 64)
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("memory_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), "embedding")
    store.add(v.where("memory_id % 2 = 0"))
    store.add(v.where("memory_id % 2 = 1"))
    store.replace_video("v3", v.where("video_id = 'v3' AND memory_id % 3 = 0"))
    store.replace_video("v4", v.limit(0))
    store.compact()
    store.add(v.where("video_id = 'v4' AND memory_id % 7 = 0"))
    return store.load().select("memory_id", "video_id", M.squared_distance(F.col("embedding"), F.lit(QUERY).cast("array<float>")).alias("d")).withColumn("d", F.round("d", 9))


def partition_round_trip(spark, folder):
    """Segments written by video, a third of the videos delivered again with other texts, and a resume that adds none but the missing."""
    place = _place(spark, "segments")
    s = table(spark, folder, "segments").select("segment_id", "video_id", F.lit("first").alias("delivery"))
    n = F.ascii(F.substring("video_id", -1, 1)) % 3
    sinks.overwrite_videos(s.where(n != 2), place)
    sinks.overwrite_videos(s.where(n == 0).withColumn("delivery", F.lit("again")), place)
    sinks.write_pending(s.withColumn("delivery", F.lit("resumed")), place)
    return spark.read.parquet(place).select("segment_id", F.col("video_id").cast("string").alias("video_id"), "delivery")


def journal_files(spark, folder):
    """Events appended to a journal in two commits, and each run's state."""
    place = _place(spark, "journal")
    e = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.lit(1).alias("generation"))
    for part in (0, 1):
        sinks.append_journal(e.where(F.col("seq") % 2 == part), place)
    return C.run_state(spark.read.schema("run_id long, seq long, event string, generation int").json(place)).select("run_id", "last_event", "events")


def model_prompts(spark, folder):
    """What a language model would be asked about each memory row."""
    m = table(spark, folder, "memory_rows")
    none = F.array().cast("array<string>")
    lists = [F.filter(F.coalesce(F.col(c), none), lambda x: x.isNotNull()) for c in ("topics", "decisions", "tasks")]
    return m.select("memory_id", F.md5(adapters.extraction_prompt(F.col("speech_text"), F.col("visual_caption"))).alias("extraction"), F.md5(adapters.summary_prompt(F.coalesce("speech_text", F.lit("")), *lists)).alias("summary"))


def window_ranks(spark, folder):
    """Every window's rank by change within its key."""
    return W.ranked_windows(_frames(spark, folder), 4).select("k", "start", F.col("rank").cast("long").alias("rank"))


def question_contract(spark, folder):
    """Segments as questions with limits and ranges, some of them broken."""
    i = F.col("segment_id")
    s = table(spark, folder, "segments")
    q = s.select("segment_id", F.when(i % 11 == 0, " ").when(i % 11 == 1, F.repeat(F.lit("x"), 1001)).otherwise(F.coalesce("text", F.lit("?"))).alias("question"), (i % 13).cast("int").alias("limit"), F.when(i % 7 != 0, F.col("start_sec")).alias("start_sec"), F.when(i % 5 != 0, F.col("end_sec")).alias("end_sec"))
    return H.questions_checked(q).select("segment_id", "error")


def control_contracts(spark, folder):
    """Hashes of three presentations of each video's frames, some of them not what they should be."""
    c = table(spark, folder, "captions").where("frame_hash IS NOT NULL").groupBy("video_id").agg(F.slice(F.array_sort(F.collect_set("frame_hash")), 1, 4).alias("f"), F.count(F.lit(1)).alias("n"))
    still = F.array_repeat(F.get("f", 0), F.size("f"))
    n = F.col("n") % 4
    return c.select("video_id", F.array_join(H.control_errors(F.col("f"), F.when(n == 1, F.col("f")).otherwise(F.reverse("f")), F.when(n == 2, F.reverse("f")).when(n == 3, F.slice(still, 1, 1)).otherwise(still)), ", ").alias("errors"))


def luma_deltas(spark, folder):
    """The mean absolute difference of each vector, as a luma grid, to that before it of its label."""
    rows = previous_row(chunked(table(spark, folder, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.round(x * 1000).cast("int")).alias("g")), ["label", "vec_id"]), ["label", "vec_id"], ["label", "g"])
    same = F.col("prev.label").eqNullSafe(F.col("label")) & F.col("prev").isNotNull()
    return rows.select("vec_id", F.when(same, mean_luma_delta(F.col("g"), F.col("prev.g"))).alias("delta"))


def hash_distances(spark, folder):
    """Differing bits between the hash of each frame and that of the frame before it in its video."""
    c = table(spark, folder, "captions").where(F.col("frame_hash").rlike(r"^[0-9a-f]{64}\z")).select("video_id", "caption_id", "frame_hash")
    rows = previous_row(chunked(c, ["video_id", "caption_id"]), ["video_id", "caption_id"], ["video_id", "frame_hash"])
    same = F.col("prev").isNotNull() & F.col("prev.video_id").eqNullSafe(F.col("video_id"))
    return rows.where(same).select("caption_id", hamming_hex(F.col("frame_hash"), F.col("prev.frame_hash")).cast("int").alias("bits"))


def frame_contract(spark, folder):
    """Frames that no selector takes."""
    c = table(spark, folder, "captions").select(F.col("video_id").alias("k"), F.col("frame_id").alias("id"), F.col("timestamp_sec").alias("t"))
    return W.frame_errors(c.where("id IS NOT NULL")).where("error <> 'time is not finite'").select("k", "error").groupBy("k", "error").agg(F.count(F.lit(1)).alias("frames"))


def required_rules(spark, folder):
    """Fail mode over rows that keep their contract: all of them come through."""
    return C.require(table(spark, folder, "orders"), {"a key": F.col("o_orderkey").isNotNull(), "a price": F.col("o_totalprice") >= 0}).select("o_orderkey")


def search_results(spark, folder):
    """A memory search as its callers see it: place, distance and similarity, filtered by source and time."""
    return M.search(_store(spark, folder), QUERY, 7, key="video_id", key_value="5", time_range=(20.0, 60.0)).select("ordinal", "time_range", F.round("similarity", 9).alias("similarity"))


QUERIES = {f.__name__: f for f in (frame_map_files, reference_files, probe_files, store_round_trip, partition_round_trip, journal_files, model_prompts, window_ranks, question_contract, control_contracts, luma_deltas, hash_distances, frame_contract, required_rules, search_results)}

_D = "list_sum(list_transform(list_zip(embedding, [" + ", ".join(f"({x!r})::FLOAT" for x in QUERY) + "]), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_HAM = " + ".join(f"bit_count(xor(('0x' || substr(h, {i}, 16))::UBIGINT, ('0x' || substr(p, {i}, 16))::UBIGINT))::INTEGER" for i in (1, 17, 33, 49))
_LIST = lambda c, n: f"array_to_string(list_filter({c}, lambda x: x IS NOT NULL)[:{n}], ', ')"
_SOME = lambda c, n: f"CASE WHEN len(list_filter({c}, lambda x: x IS NOT NULL)) > 0 THEN {_LIST(c, n)} ELSE 'None' END"

SQL = {
    "frame_map_files": "WITH o AS (SELECT video_id, source_path, min(timestamp_sec) AS t FROM captions WHERE frame_id IS NOT NULL AND source_path IS NOT NULL AND NOT isnan(timestamp_sec) AND starts_with(source_path, 'frames_fixed/') GROUP BY ALL) SELECT video_id, source_path, row_number() OVER (PARTITION BY video_id ORDER BY t, encode(source_path)) - 1 AS n, t AS timestamp_sec FROM o",
    "reference_files": r"""SELECT segment_id, video_id, '"' || regexp_replace(text, '[\r\n]', ' ', 'g') || '", \' AS label FROM segments WHERE text IS NOT NULL AND text <> ''""",
    "probe_files": "SELECT video_id, kind, CASE WHEN kind = 'audio' AND (length(video_id) + ascii(right(video_id, 1))) % 5 = 0 THEN 0.021333 ELSE 0 END::DOUBLE AS start_sec, source_duration_seconds AS duration_sec, NOT (kind = 'audio' AND (length(video_id) + ascii(right(video_id, 1))) % 5 = 0) AS origin_ok FROM videos, (VALUES ('video'), ('audio')) k(kind)",
    "store_round_trip": f"SELECT vec_id AS memory_id, 'v' || label AS video_id, round({_D}, 9) AS d FROM embeddings WHERE CASE label WHEN 3 THEN vec_id % 3 = 0 WHEN 4 THEN vec_id % 7 = 0 ELSE true END",
    "partition_round_trip": "SELECT segment_id, video_id, CASE ascii(right(video_id, 1)) % 3 WHEN 0 THEN 'again' WHEN 1 THEN 'first' ELSE 'resumed' END AS delivery FROM segments",
    "journal_files": "SELECT user_id AS run_id, arg_max(event_type, event_id) AS last_event, count(*) AS events FROM events GROUP BY user_id",
    "model_prompts": f"""SELECT memory_id, md5('Return one JSON object with topics, decisions, tasks, people, entities (lists of text), intent, summary, confidence.' || chr(10) || 'Speech: ' || coalesce(speech_text, '') || chr(10) || 'Unvalidated visual observation: ' || CASE WHEN regexp_matches(visual_caption, '[^\\s\\x{{a0}}]') THEN visual_caption ELSE 'none' END) AS extraction,
  md5('Summarize this session.' || chr(10) || 'Transcript: ' || left(coalesce(speech_text, ''), 2000) || chr(10) || 'Topics: ' || coalesce({_LIST("topics", 10)}, '') || chr(10) || 'Decisions: ' || {_SOME("decisions", 5)} || chr(10) || 'Tasks: ' || {_SOME("tasks", 5)}) AS summary FROM memory_rows""",
    "window_ranks": _F + " SELECT k, start, row_number() OVER (PARTITION BY k ORDER BY metric DESC, t0) AS rank FROM m",
    "question_contract": r"""WITH q AS (SELECT segment_id, CASE segment_id % 11 WHEN 0 THEN ' ' WHEN 1 THEN repeat('x', 1001) ELSE coalesce(text, '?') END AS q, segment_id % 13 AS l, CASE WHEN segment_id % 7 <> 0 THEN start_sec END AS a, CASE WHEN segment_id % 5 <> 0 THEN end_sec END AS b FROM segments)
SELECT segment_id, CASE WHEN NOT regexp_matches(q, '[^\s\x{a0}]') THEN 'question must not be blank' WHEN length(q) > 1000 THEN 'question is too long' WHEN l NOT BETWEEN 1 AND 10 THEN 'limit must be 1 to 10' WHEN (a IS NULL) <> (b IS NULL) THEN 'a range needs both ends' WHEN a IS NOT NULL AND (NOT isfinite(a) OR NOT isfinite(b) OR a < 0 OR b < a) THEN 'range must be finite and ordered' END AS error FROM q""",
    "control_contracts": """WITH c AS (SELECT video_id, (list_sort(list_distinct(list(frame_hash))))[:4] AS f, count(*) % 4 AS n FROM captions WHERE frame_hash IS NOT NULL GROUP BY video_id)
SELECT video_id, concat_ws(', ', CASE WHEN n = 1 AND list_reverse(f) <> f THEN 'reverse is not the reversed forward' END, CASE WHEN n = 2 AND len(f) > 1 THEN 'still is not one frame' END, CASE WHEN n = 2 AND len(f) > 1 THEN 'still is not the first frame' END, CASE WHEN n = 3 AND len(f) > 1 THEN 'sizes differ' END) AS errors FROM c""",
    "luma_deltas": "WITH g AS (SELECT label, vec_id, list_transform(embedding, lambda x: round(x * 1000)::INTEGER) AS g FROM embeddings), p AS (SELECT vec_id, g, lag(g) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM g) SELECT vec_id, CASE WHEN q IS NOT NULL THEN round(list_sum(list_transform(list_zip(g, q), lambda z: abs(z[1] - z[2])))::DOUBLE / len(g), 6) END AS delta FROM p",
    "hash_distances": f"WITH c AS (SELECT caption_id, frame_hash AS h, lag(frame_hash) OVER (PARTITION BY video_id ORDER BY caption_id) AS p FROM captions WHERE regexp_full_match(frame_hash, '[0-9a-f]{{64}}')) SELECT caption_id, {_HAM} AS bits FROM c WHERE p IS NOT NULL",
    "frame_contract": "WITH c AS (SELECT video_id AS k, frame_id AS id, timestamp_sec AS t FROM captions WHERE frame_id IS NOT NULL), e AS (SELECT k, 'frame id repeated' AS error FROM c GROUP BY k, id HAVING count(*) > 1 UNION ALL SELECT k, 'times do not increase' FROM c GROUP BY k, t HAVING count(*) > 1) SELECT k, error, count(*) AS frames FROM e GROUP BY ALL",
    "required_rules": "SELECT o_orderkey FROM orders",
    "search_results": f"SELECT vec_id AS ordinal, [(vec_id % 100)::DOUBLE, (vec_id % 100 + 5)::DOUBLE] AS time_range, round(1 / (1 + {_D}), 9) AS similarity FROM embeddings WHERE label = 5 AND vec_id % 100 <= 60 AND vec_id % 100 + 5 >= 20 ORDER BY {_D}, vec_id LIMIT 7",
}
