"""The stages from videos to memory as one lazy composition: an ordered list of functions, an action only at each stage's sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import adapters
from tidemark.config import Config
from tidemark.functions.columns import DERIVED
from tidemark.operators.align import context_blocks
from tidemark.operators.hypotheses import parse_semantics
from tidemark.operators.memory import searchable_text, split_by_acceptance
from tidemark.operators.quality import frame_verdicts
from tidemark.session import scratch
from tidemark.sources.sinks import overwrite_videos, write_pending

PHASES = ("1", "2", "3", "3.5", "4", "5", "6", "7")
# Phases 1 to 4 but 3.5 read media; their results enter as tables of these names.
TABLES = {"1": "frames", "2": "segments", "3": "frames", "3.5": "quality", "4": "captions", "5": "blocks", "6": "semantics", "7": "memory"}


def phase_range(start: str, end: str) -> list[str]:
    """Phases from start to end, both known and in order."""
    a, b = str(start), str(end)
    if a not in PHASES or b not in PHASES or PHASES.index(a) > PHASES.index(b):
        raise ValueError(f"phases are {', '.join(PHASES)}, in order")
    return list(PHASES[PHASES.index(a) : PHASES.index(b) + 1])


def semantic_rows(blocks: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """Semantic structure of context blocks by a language model. An answer that breaks the contract is an error on the executor."""
    answer = adapters.generate(adapters.extraction_prompt(F.col("speech"), F.col("caption")), model)
    rows = blocks.withColumn("p", parse_semantics(answer))
    rows = rows.where(F.when(F.col("p.error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("model answer: "), F.col("p.error"))).cast("boolean")))
    return rows.select("video_id", "block_id", "p.topics", "p.decisions", "p.tasks", "p.entities", "p.intent", "p.summary", "p.confidence", F.lit(DERIVED).alias("verification_status"), F.lit(False).alias("accepted_as_fact"))


def memory_rows(semantics: DataFrame, blocks: DataFrame, dims: int, model=None) -> DataFrame:
    """Memory rows with vectors: blocks with something to say, accepted and unvalidated lists apart."""
    split = split_by_acceptance(semantics.withColumn("all_topics", F.col("topics")))
    text = searchable_text(F.col("summary"), F.col("all_topics"), F.col("entities"), F.col("decisions"), F.col("tasks"), F.col("accepted_as_fact"))
    rows = split.withColumn("searchable_text", text).where(F.col("searchable_text") != "").drop("all_topics")
    ctx = blocks.select("video_id", "block_id", F.array("start_sec", "end_sec").alias("time_range"), F.col("speech").alias("speech_text"), F.col("caption").alias("visual_caption"), "source_type", "raw_transcript_segment_id", "frame_ids", "visual_status")
    return rows.join(ctx, ["video_id", "block_id"]).withColumn("embedding", adapters.embed(F.col("searchable_text"), dims, model))


@dataclass
class Pipeline:
    """Runs phases 3.5 and 5 to 7 over tables in `root`; phases 1 to 4 are adapters whose tables (frames, segments, captions) must be
    there. 3.5 reads frames (video_id, frame_no unique, path unique, content) and writes their verdicts."""

    spark: SparkSession
    root: str
    config: Config
    language_model: Callable[[str], str] | None = None
    embedder: Callable | None = None

    def _read(self, name: str, video_id: str | None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}").withColumn("video_id", F.col("video_id").cast("string"))
        return df if video_id is None else df.where(F.col("video_id") == video_id)

    def _sink(self, rows: DataFrame, name: str) -> None:
        (write_pending if self.config["pipeline.skip_existing"] else overwrite_videos)(rows, f"{self.root}/{name}")

    def _phase(self, name: str, make: Callable[[], DataFrame]) -> None:
        with scratch(self.spark):  # cut lineage is of no use once the phase's table is written
            self._sink(make(), name)

    def run(self, start: str = "5", end: str = "7", video_id: str | None = None) -> list[str]:
        """The phases that ran, without those whose tables were only looked for; the first failure stops the run."""
        done = []
        for phase in phase_range(start, end):
            if phase == "5":
                self._phase("blocks", lambda: context_blocks(self._read("segments", video_id), self._read("captions", video_id), float(self.config["pipeline.time_window_sec"])))
            elif phase == "6":
                self._phase("semantics", lambda: semantic_rows(self._read("blocks", video_id), self.language_model))
            elif phase == "7":
                self._phase("memory", lambda: memory_rows(self._read("semantics", video_id), self._read("blocks", video_id), int(self.config["embeddings.dimension"]), self.embedder))
            elif phase == "3.5":
                self._phase("quality", lambda: frame_verdicts(self._read("frames", video_id), "video_id", "frame_no"))
            else:
                self._read(TABLES[phase], video_id).limit(1).collect()  # media phases: their table must exist
                continue
            done.append(phase)
        return done
