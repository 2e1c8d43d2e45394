"""The question service and its edges: validated questions over a memory table, a command line and a small HTTP server.

    python -m tidemark.service MEMORY_PATH ask "what happened" --video P0000_00 --limit 5
    python -m tidemark.service MEMORY_PATH serve --port 8000
    python -m tidemark.service STORE_PATH visual-index captions.json
    python -m tidemark.service STORE_PATH visual-search "a hand on the lid" --video P0000_00
"""

from __future__ import annotations

import argparse
import json
import math
import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import adapters
from tidemark.adapters import hashed_embedding
from tidemark.functions.columns import accepted_fact, card_range, card_status
from tidemark.operators import memory as M
from tidemark.operators.policy import caption_documents
from tidemark.sources import json_documents
from tidemark.sources.sinks import VideoStore

MAX_QUESTION, MAX_RESULTS = 1000, 10
# The answers that go with each state.
ANSWERS = {
    "supported": "Independently accepted evidence was retrieved; inspect the cited cards before relying on the claim.",
    "unaccepted": "I found potentially relevant timestamped observations, but none is independently accepted evidence for a factual answer.",
    "none": "No indexed observations matched this question{scope} in the requested time range.",
    "unavailable": "No local visual-retrieval index is available yet. Index timestamped observations first.",
}


def checked_question(question, limit=5, start_sec=None, end_sec=None) -> tuple[str, int, tuple[float, float] | None]:
    """(question, limit, range); ValueError says which rule is broken."""
    if not isinstance(question, str) or not question.strip() or len(question.strip()) > MAX_QUESTION:
        raise ValueError("question must have 1 to 1000 characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_RESULTS:
        raise ValueError("limit must be 1 to 10")
    if (start_sec is None) != (end_sec is None):
        raise ValueError("a range needs both ends")
    if start_sec is None:
        return question.strip(), limit, None
    ends = []
    for x in (start_sec, end_sec):
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0:
            raise ValueError("range must be finite and not negative")
        ends.append(float(x))
    if ends[1] < ends[0]:
        raise ValueError("range must be ordered")
    return question.strip(), limit, (ends[0], ends[1])


class QuestionService:
    """Cards and statuses over a memory of rows with vectors. Distance ranks; it never accepts."""

    def __init__(self, spark: SparkSession, path: str, dims: int = 384, ordinal: str | None = None, embedder=None, language_model=None):
        """`ordinal` orders rows and breaks ties: a column of the memory, by default one made of the video and the number in its block id."""
        if isinstance(dims, bool) or not isinstance(dims, int) or dims < 1:
            raise ValueError("dimension must be a positive integer")
        self.spark, self.path, self.dims, self.ordinal = spark, path, dims, ordinal or "__ordinal"
        self.embedder = embedder or (lambda text: hashed_embedding(text, dims))
        self.language_model = language_model
        if len(self.embedder("dimension")) != dims:
            raise ValueError("embedder and memory must have the same dimension")
        self._lock = threading.Lock()

    @cached_property
    def _rows(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        if self.ordinal != "__ordinal":
            return rows
        number = F.regexp_extract("block_id", r"(\d+)$", 1).try_cast("long")  # ctx_10000 comes after ctx_9999
        return rows.withColumn("__ordinal", F.struct("video_id", number.alias("n"), "block_id"))

    def rows(self) -> DataFrame:
        with self._lock:  # one reader builds it, the others wait
            return self._rows

    def query(self, text: str, k: int = 5, video_id: str | None = None, time_range=None) -> DataFrame:
        return M.search(self.rows(), list(map(float, self.embedder(text))), k, self.ordinal, key="video_id", key_value=video_id, time_range=time_range)

    def ask(self, question, video_id: str | None = None, limit: int = 5, start_sec=None, end_sec=None) -> dict:
        question, limit, span = checked_question(question, limit, start_sec, end_sec)
        out = {"question": question, "video_id": video_id, "requested_source_time_range_sec": list(span) if span else None}
        try:
            found = self.query(question, limit, video_id, span)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or isinstance(e, FileNotFoundError):
                return {"status": "index_unavailable", "answer_status": "insufficient_evidence", "answer": ANSWERS["unavailable"], **out, "evidence_cards": []}
            raise
        status = card_status(F.col("verification_status"), F.col("source_type"))
        has = lambda c: F.col(c) if c in found.columns else F.lit(None)
        cards = found.orderBy("distance", self.ordinal).select("video_id", card_range(F.col("time_range"), has("frame_timestamp_sec")).alias("source_time_range_sec"), F.coalesce(has("observation").cast("string"), has("visual_caption").cast("string"), F.lit("")).alias("observation"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"), status.alias("verification_status"), accepted_fact(F.col("accepted_as_fact"), status).alias("accepted_as_fact"), F.col("distance").alias("retrieval_distance_ranking_only"))
        got = [r.asDict() for r in cards.collect()]  # at most MAX_RESULTS
        if any(c["accepted_as_fact"] for c in got):
            state, answer = "supported_by_accepted_evidence", ANSWERS["supported"]
        else:
            state, answer = "insufficient_evidence", ANSWERS["unaccepted"] if got else ANSWERS["none"].format(scope=" for the supplied source video" if video_id else "")
        return {"status": "ok" if got else "no_matches", "answer_status": state, "answer": answer, **out, "evidence_cards": got}

    def listed(self, what: str, limit: int = 20) -> dict:
        """Tasks and decisions: the first `limit`, and how many there are in all. Topics: the first `limit`, and their number."""
        rows = self.rows()
        if what == "topics":
            got = [r.asDict() for r in M.top_topics(rows, self.ordinal, limit).collect()]
            return {"topics": got, "total": len(got)}
        if what == "videos":
            got = sorted(r[0] for r in rows.select("video_id").distinct().collect())
            return {"videos": got, "total": len(got)}
        items = M.accepted_items(rows, what, what[:-1], self.ordinal)
        first = items.orderBy(self.ordinal, "position").limit(limit)
        return {what: [r.asDict() for r in first.drop("__ordinal").collect()], "total": items.count()}

    def summary(self, video_id: str) -> dict:
        """The numbers and topics of a video, the first decisions and tasks, and a language model's summary of them."""
        rows = self.rows().where(F.col("video_id") == video_id)
        heads = M.video_summaries(rows, self.ordinal)
        first = lambda field: [r[0] for r in M.accepted_items(rows, field, "item", self.ordinal).orderBy(self.ordinal, "position").limit(5).select("item").collect()]
        decisions, tasks = first("decisions"), first("tasks")
        texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        prompt = adapters.summary_prompt(F.col("transcript_head"), F.col("topics"), texts(decisions), texts(tasks))
        got = heads.withColumn("summary", adapters.generate(prompt, self.language_model)).collect()
        if not got:
            raise KeyError(video_id)
        return got[0].asDict() | {"duration_blocks": got[0]["blocks"], "first_decisions": decisions, "first_tasks": tasks}


CAPTION_SCHEMA = "video_id string, captions array<struct<frame_id:string,timestamp_sec:double,source_timestamp_sec:double,source_path:string,caption:string,source_type:string,model:string,backend:string,device:string>>"


def index_captions(store: VideoStore, captions: DataFrame, video_id: str, embedder=None) -> int:
    """Replace a video's rows in a caption-only store by its captions as documents; how many there are. One caption that breaks a rule
    refuses them all."""
    docs = caption_documents(captions)
    bad = docs.where("error IS NOT NULL").select("error").limit(1).collect()
    if bad:
        raise ValueError(bad[0][0])
    rows = docs.drop("error").withColumn("embedding", adapters.embed(F.col("text"), store.dims, embedder)).withColumn("block_id", F.coalesce("frame_id", F.lit("")))
    store.replace_video(video_id, rows)
    return rows.count()


def index_caption_file(store: VideoStore, path: str, embedder=None) -> int:
    """index_captions of one captions document."""
    doc = json_documents(store.spark, path, CAPTION_SCHEMA)
    head = doc.select("video_id", F.col("captions").isNull().alias("none")).collect()
    if len(head) != 1 or head[0][0] is None or head[0][1]:
        raise ValueError("a captions document needs a video_id and a list of captions")
    return index_captions(store, doc.select("video_id", F.explode("captions").alias("c")).select("video_id", "c.*"), head[0][0], embedder)


def search_captions(store: VideoStore, query: str, limit: int = 5, video_id: str | None = None, embedder=None) -> list[dict]:
    """The observations nearest to a text: what a model saw, never an answer."""
    vector = (embedder or (lambda t: hashed_embedding(t, store.dims)))(query)
    found = M.search(store.load(), list(map(float, vector)), limit, "frame_timestamp_sec", key="video_id", key_value=video_id)
    return [r.asDict() for r in found.select("video_id", "frame_timestamp_sec", "frame_id", "observation", "verification_status", "distance").collect()]


def respond(service: QuestionService, method: str, path: str, params: dict) -> tuple[int, dict]:
    """(HTTP status, body) of a request."""
    number = lambda k: float(params[k]) if params.get(k) not in (None, "") else None
    try:
        if path == "/" and method == "GET":
            return 200, {"service": "tidemark", "routes": ["/ask", "/query", "/summary/{id}", "/tasks", "/decisions", "/topics", "/videos"]}
        if path == "/ask" and method in ("GET", "POST"):
            body = service.ask(params.get("question"), params.get("video_id"), int(params.get("limit", 5)), number("start_sec"), number("end_sec"))
            return (503 if body["status"] == "index_unavailable" else 200), body
        if path == "/query" and method == "POST":
            q, k, span = checked_question(params.get("query"), int(params.get("k", 5)), number("start_sec"), number("end_sec"))
            got = [r.asDict() for r in service.query(q, k, params.get("video_id"), span).drop("embedding").collect()]
            return 200, {"results": [{c: v for c, v in r.items() if c != "__ordinal"} for r in got], "total": len(got)}
        if path.startswith("/summary/") and method == "GET":
            from tidemark.sources import check_video_id

            return 200, service.summary(check_video_id(path.removeprefix("/summary/")))
        if path[1:] in ("tasks", "decisions", "topics", "videos") and method == "GET":
            limit = int(params.get("limit", 20))
            if not 1 <= limit <= 1000:
                raise ValueError("limit must be 1 to 1000")
            return 200, service.listed(path[1:], limit)
        return 404, {"error": "no such route"}
    except KeyError:
        return 404, {"error": "no such video"}
    except (ValueError, TypeError) as e:
        return 422, {"error": str(e)}
    except Exception:  # noqa: BLE001  (details stay in the log)
        return 500, {"error": "internal error"}


def serve(service: QuestionService, port: int) -> None:
    """A loopback server of the standard library."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qsl, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            url = urlsplit(self.path)
            params = dict(parse_qsl(url.query))
            n = int(self.headers.get("Content-Length") or 0)
            if n:
                params |= json.loads(self.rfile.read(min(n, 1 << 16)) or b"{}")
            code, body = respond(service, method, url.path, params)
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self._do("GET")

        def do_POST(self):  # noqa: N802
            self._do("POST")

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("memory")
    p.add_argument("--dims", type=int, default=384)
    sub = p.add_subparsers(dest="do", required=True)
    for name in ("ask", "query"):
        q = sub.add_parser(name)
        q.add_argument("text")
        q.add_argument("--video")
        q.add_argument("--limit", type=int, default=5)
        q.add_argument("--start", type=float)
        q.add_argument("--end", type=float)
    for name in ("tasks", "decisions", "topics", "videos"):
        sub.add_parser(name).add_argument("--limit", type=int, default=20)
    sub.add_parser("summarize").add_argument("video")
    sub.add_parser("serve").add_argument("--port", type=int, default=8000)
    sub.add_parser("visual-index").add_argument("captions")
    v = sub.add_parser("visual-search")
    v.add_argument("text")
    v.add_argument("--video")
    v.add_argument("--limit", type=int, default=5)
    a = p.parse_args(argv)
    if spark is None:
        from tidemark.session import local_session

        spark = local_session()
    if a.do.startswith("visual-"):
        store = VideoStore(spark, a.memory, a.dims)
        try:
            body = {"indexed": index_caption_file(store, a.captions)} if a.do == "visual-index" else {"note": "unvalidated model observations; no answer was generated", "results": search_captions(store, a.text, a.limit, a.video)}
        except (ValueError, OSError) as e:
            print(json.dumps({"error": str(e)}))
            return 1
        print(json.dumps(body, default=str, indent=2))
        return 0
    service = QuestionService(spark, a.memory, a.dims)
    if a.do == "serve":
        serve(service, a.port)
        return 0
    if a.do in ("ask", "query"):
        method, path, params = ("GET", "/ask", {"question": a.text}) if a.do == "ask" else ("POST", "/query", {"query": a.text, "k": a.limit})
        params |= {"video_id": a.video, "limit": a.limit, "start_sec": a.start, "end_sec": a.end}
    else:
        method, path, params = "GET", f"/summary/{a.video}" if a.do == "summarize" else f"/{a.do}", {} if a.do == "summarize" else {"limit": a.limit}
    code, body = respond(service, method, path, params)
    print(json.dumps(body, default=str, indent=2))
    return 0 if code == 200 else 1


if __name__ == "__main__":
    raise SystemExit(main())
