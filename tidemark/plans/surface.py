"""Queries over adapters and the streaming extension: rows only for stand-in models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import adapters
from tidemark.pipeline import memory_rows, semantic_rows
from tidemark.operators.align import context_blocks
from tidemark.session import shared_folder, table
from tidemark.streaming import replace_stream


def embed_stub(spark, folder):
    rows = table(spark, folder, "memory_rows").where("searchable_text IS NOT NULL").select("memory_id", adapters.embed(F.col("searchable_text"), 64).alias("e"))
    return rows.select("memory_id", F.col("e").alias("embedding"))


def caption_stub(spark, folder):
    frames = table(spark, folder, "captions").select(F.col("caption_id").cast("string").alias("frame_id"), F.col("source_path").cast("binary").alias("content"))
    return adapters.caption_frames(frames).select("frame_id", "success", "caption")


def llm_stub(spark, folder):
    """Context blocks to semantic rows to memory rows with the stand-in models."""
    blocks = context_blocks(table(spark, folder, "segments"), table(spark, folder, "captions"))
    return memory_rows(semantic_rows(blocks), blocks, 64).select("video_id", "block_id", "searchable_text", "visual_status", "embedding")


def stream_keyed_replace(spark, folder):
    """Memory rows as a stream of several files, merged micro-batch by micro-batch: of each (video_id, block_id) the latest delivery."""
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, folder, "memory_rows").select("memory_id", "video_id", "block_id", "source_type")
    rows.repartition(3, (F.col("memory_id") % 3)).write.parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    replace_stream(stream, f"{home}/out", f"{home}/checkpoint", keys=["block_id"], ordinal="memory_id").awaitTermination()
    return spark.read.parquet(f"{home}/out").select("memory_id", F.col("video_id").cast("string").alias("video_id"), "block_id", "source_type")


QUERIES = {f.__name__: f for f in (embed_stub, caption_stub, llm_stub, stream_keyed_replace)}
SQL = {"stream_keyed_replace": "SELECT memory_id, video_id, block_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY video_id, block_id ORDER BY memory_id DESC) AS rn FROM memory_rows) WHERE rn = 1"}
