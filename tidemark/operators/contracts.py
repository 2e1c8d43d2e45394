"""Contracts as data: each rule is a named predicate, and what breaks it is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clock_seconds, https_url, nonblank, overlaps_open, safe_id, sha256_hex
from tidemark.operators.intervals import finite
from tidemark.operators.ordered import chunked, previous_row
from tidemark.session import cut

# Bounds of manifests.
MAX_CLIP_SECONDS, MAX_SOURCE_BYTES, MAX_RECORDS = 120.0, 256 * 1024 * 1024, 10


def violations(df: DataFrame, rules: dict[str, Column], name: str = "violations") -> DataFrame:
    """Adds the names of the rules that a row breaks; a rule that is null is broken."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])))


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Fail mode: the rows, or an error on the executor at the first row that breaks a rule."""
    for n, ok in rules.items():
        df = df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"contract broken: {n}")).cast("boolean")))
    return df


def manifest_rules(max_clip: float = MAX_CLIP_SECONDS, max_bytes: int = MAX_SOURCE_BYTES) -> dict[str, Column]:
    c = F.col
    t = c("clip_interval_seconds")
    a, b, d = F.get(t, 0), F.get(t, 1), c("source_duration_seconds")
    return {
        "video_id": safe_id(c("video_id")),
        "split": nonblank(c("split")),
        "license_id": nonblank(c("license_id")),
        "source_url": https_url(c("source_url")),
        "timestamp_unit": c("timestamp_unit") == "seconds",
        "timestamp_origin": c("timestamp_origin") == "source_video_start",
        "source_duration_seconds": finite(d),
        "clip_interval_seconds": (F.size(t) == 2) & finite(a) & finite(b) & (a >= 0) & (a < b) & (b <= d),
        "clip_length": b - a <= max_clip,
        "size_bytes": c("size_bytes").isNull() | c("size_bytes").between(1, max_bytes),
        "verification_status": c("verification_status").isin("pending", "verified"),
        "sha256": F.when(c("verification_status") == "verified", sha256_hex(c("sha256"))).otherwise(c("sha256").isNull() | sha256_hex(c("sha256"))),
        "verified_size": (c("verification_status") != "verified") | c("size_bytes").isNotNull(),
    }


def manifest_violations(records: DataFrame) -> DataFrame:
    """Records with the rules that each breaks, an id that occurs twice included."""
    again = records.groupBy("video_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("video_id", F.lit(True).alias("__again"))
    rows = violations(records, manifest_rules()).join(again, "video_id", "left")
    return rows.withColumn("violations", F.when(F.col("__again"), F.concat("violations", F.array(F.lit("unique video_id")))).otherwise(F.col("violations"))).drop("__again")


def verify_sources(records: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared against observed (video_id, size, digest, seconds): what differs, by at most a millisecond in duration."""
    j = records.join(observed, "video_id", "left")
    return violations(j, {"present": F.col("size").isNotNull(), "size": F.col("size_bytes") == F.col("size"), "sha256": F.col("sha256") == F.col("digest"), "duration": F.abs(F.col("source_duration_seconds") - F.col("seconds")) <= 0.001}, "differences")


def clip_references(annotations: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clipped, rejected) of evaluation references (video_id, annotation_id, start_text, stop_text, label).

    All rows of a video are checked before any is left out for lying outside the clip: clock texts, order, source duration, a unique
    nonempty id, a label. Clipped ones carry source and clip intervals, the latter from the clip's start.
    """
    a = annotations.withColumns({"s": clock_seconds(F.col("start_text")), "e": clock_seconds(F.col("stop_text"))})
    n = annotations.groupBy("video_id", "annotation_id").agg(F.count(F.lit(1)).alias("__n"))
    t = F.col("clip_interval_seconds")
    rows = a.join(n, ["video_id", "annotation_id"], "left").join(records.select("video_id", "clip_interval_seconds", "source_duration_seconds"), "video_id")
    checked = violations(rows, {"clock text": F.col("s").isNotNull() & F.col("e").isNotNull(), "interval": (F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("source_duration_seconds")), "annotation_id": nonblank(F.col("annotation_id")) & (F.col("__n") == 1), "label": nonblank(F.col("label"))})
    good = checked.where(F.size("violations") == 0).where(overlaps_open(F.col("s"), F.col("e"), t[0], t[1]))
    return good.select("video_id", "annotation_id", "label", F.col("s").alias("source_start"), F.col("e").alias("source_end"), (F.greatest("s", t[0]) - t[0]).alias("clip_start"), (F.least("e", t[1]) - t[0]).alias("clip_end")), checked.where(F.size("violations") > 0).select("video_id", "annotation_id", "violations")


def label_leaks(labels: DataFrame, corpus: DataFrame, text: str = "text", width: int = 8) -> DataFrame:
    """Corpus rows (doc_id) that hold any `width` words in a row of a label, or all words of a shorter one: a firewall between evaluation
    and inputs. Words are runs of letters and digits, lower-cased; labels without words do not count. Both sides meet on hashes of word
    windows, not on all pairs."""
    words = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)
    named = lambda df: df.where(F.col(text).isNotNull()).withColumn("w", words(F.col(text))).where(F.size("w") > 0)
    size = F.size("w")

    def windows(n: Column) -> Column:
        at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(n.alias("n"), F.xxhash64(F.slice("w", i, n)).alias("h"), F.hash(F.slice("w", i, n)).alias("g")))

    wanted = cut(named(labels).select(F.explode(windows(F.least(size, F.lit(width)))).alias("x")).select("x.*").distinct())
    lengths = sorted(r.n for r in wanted.select("n").distinct().collect())  # at most `width` numbers
    if not lengths:
        return corpus.select("doc_id").limit(0)
    pieces = named(corpus).select("doc_id", F.explode(F.concat(*[windows(F.lit(n)) for n in lengths])).alias("x")).select("doc_id", "x.*")
    return pieces.join(F.broadcast(wanted) if wanted.count() <= 10_000 else wanted, ["n", "h", "g"], "left_semi").select("doc_id").distinct()


def run_state(journal: DataFrame) -> DataFrame:
    """Per run of a journal (run_id, seq, event, generation): its last event, the number of events, and what a new start must do:
    return the stored result of a completed run, refuse any other. Generations that fall are an error."""
    order = ["run_id", "seq"]
    rows = previous_row(chunked(journal.select("run_id", "seq", "event", "generation"), order), order, ["run_id", "generation"])  # a long run is cut into chunks
    fell = F.coalesce(F.col("prev.run_id").eqNullSafe(F.col("run_id")) & (F.col("prev.generation") > F.col("generation")), F.lit(False))
    runs = rows.groupBy("run_id").agg(F.max_by("event", "seq").alias("last_event"), F.count(F.lit(1)).alias("events"), F.max(fell).alias("generation_falls"))
    return runs.select("run_id", "last_event", "events", F.when(F.col("last_event") == "completed", "return_stored").otherwise("refuse").alias("on_start"), "generation_falls")
