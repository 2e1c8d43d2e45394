"""Adapters for external models: protocols in Arrow batches, with deterministic stand-ins that claim no accuracy."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import nonblank


def hashed_embedding(text: str, dims: int) -> np.ndarray:
    """Unit vector of hashed words; equal texts have equal vectors."""
    v = np.zeros(dims, np.float32)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(text: Column, dims: int = 384, model: Callable[[list[str], int], np.ndarray] | None = None) -> Column:
    """array<float> of each text; null for null. `model` encodes a batch of texts and must give finite rows of `dims`."""

    @F.pandas_udf("array<float>")
    def work(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.empty(len(s), object)
        if known.any():
            texts = s[known].tolist()
            m = np.asarray(model(texts, dims) if model else [hashed_embedding(t, dims) for t in texts], np.float32)
            if m.shape != (len(texts), dims) or not np.isfinite(m).all():
                raise ValueError("an embedder must return finite rows of the declared dimension")
            for i, v in zip(np.flatnonzero(known), m):
                out[i] = v
        return pd.Series(out)

    return work(text)


def caption_frames(frames: DataFrame, model: Callable[[bytes], str] | None = None, name: str = "stand-in") -> DataFrame:
    """(frame_id, caption, success, source_type, model, error) of frames (frame_id, content). A frame whose captioning raises has
    success false and the error; the caller decides whether the batch stands. The model is loaded once per task by the callable."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for frame, content in zip(pdf["frame_id"], pdf["content"]):
                try:
                    text = model(bytes(content)) if model else "frame " + hashlib.sha256(bytes(content)).hexdigest()[:8]
                    out.append((frame, text, True, "model", name, None))
                except Exception as e:  # noqa: BLE001
                    out.append((frame, None, False, "model", name, str(e)))
            yield pd.DataFrame(out, columns=["frame_id", "caption", "success", "source_type", "model", "error"])

    return frames.select("frame_id", "content").mapInPandas(work, "frame_id string, caption string, success boolean, source_type string, model string, error string")


def observe_windows(windows: DataFrame, model: Callable[[list[str], list[float]], str] | None = None, name: str = "stand-in") -> DataFrame:
    """(window_id, observation, fps, success, error) of windows (window_id, frame_ids, times); times must increase."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, ids, times in zip(pdf["window_id"], pdf["frame_ids"], pdf["times"]):
                t = [float(x) for x in times]
                if len(t) < 2 or len(t) != len(ids) or any(b <= a for a, b in zip(t, t[1:])):
                    out.append((w, None, None, False, "times must increase, one per frame"))
                    continue
                text = model(list(ids), t) if model else f"{len(t)} frames from {t[0]:.3f} to {t[-1]:.3f}"
                out.append((w, text, (len(t) - 1) / (t[-1] - t[0]), True, None))
            yield pd.DataFrame(out, columns=["window_id", "observation", "fps", "success", "error"])

    return windows.select("window_id", "frame_ids", "times").mapInPandas(work, "window_id string, observation string, fps double, success boolean, error string")


def transcribe(audio: DataFrame, model: Callable[[bytes], list[tuple[float, float, str, float]]] | None = None) -> DataFrame:
    """Segments (video_id, id, start_sec, end_sec, text, no_speech_prob, source_type) of audio (video_id, content): one row in, any
    number out. Null content is a video without an audio stream: one row with source_type no_audio_stream and no times."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, content in zip(pdf["video_id"], pdf["content"]):
                if content is None:
                    out.append((v, None, None, None, "", None, "no_audio_stream"))
                    continue
                got = model(bytes(content)) if model else [(0.0, max(0.1, len(content) / 32_000), hashlib.sha256(bytes(content)).hexdigest()[:8], 0.0)]
                out += [(v, i, a, b, text.strip(), p, "model_transcript") for i, (a, b, text, p) in enumerate(got)]
            yield pd.DataFrame(out, columns=["video_id", "id", "start_sec", "end_sec", "text", "no_speech_prob", "source_type"]).astype({"id": "Int64"})

    return audio.select("video_id", "content").mapInPandas(work, "video_id string, id long, start_sec double, end_sec double, text string, no_speech_prob double, source_type string")


def generate(prompt: Column, model: Callable[[str], str] | None = None) -> Column:
    """A model's answer to each prompt; an empty answer is an error. The stand-in answers with a valid semantic structure."""

    @F.pandas_udf("string")
    def work(s: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            a = model(p) if model else json.dumps({"topics": [], "decisions": [], "tasks": [], "people": [], "entities": [], "intent": "informational", "summary": " ".join(p.split()[-12:]) or "empty", "confidence": 0.0})
            if not a or not a.strip():
                raise ValueError("a model must not answer with nothing")
            return a

        return s.map(one)

    return work(prompt)


def http_model(url: str, name: str, temperature: float = 0.0, most_tokens: int = 512, timeout: float = 120.0, probe: float = 5.0) -> Callable[[str], str]:
    """A language model behind a local HTTP endpoint (GET /api/tags, POST /api/generate). It is asked once here whether it is there;
    an answer that does not come within `timeout` seconds, or is no JSON with a response, is an error."""
    from urllib.request import Request, urlopen

    base = url.rstrip("/")
    try:
        with urlopen(f"{base}/api/tags", timeout=probe) as r:  # noqa: S310
            r.read()
    except OSError as e:
        raise ConnectionError(f"no language model at {base}") from e

    def ask(prompt: str) -> str:
        body = {"model": name, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_predict": most_tokens}}
        try:
            with urlopen(Request(f"{base}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:  # noqa: S310
                return json.loads(r.read())["response"]
        except (OSError, ValueError, KeyError) as e:
            raise RuntimeError("the language model gave no answer") from e

    return ask


def extraction_prompt(speech: Column, caption: Column) -> Column:
    """The question put to a language model about one context block."""
    return F.concat(F.lit("Return one JSON object with topics, decisions, tasks, people, entities (lists of text), intent, summary, confidence.\nSpeech: "), F.coalesce(speech, F.lit("")), F.lit("\nUnvalidated visual observation: "), F.when(nonblank(caption), caption).otherwise("none"))


def summary_prompt(head: Column, topics: Column, decisions: Column, tasks: Column) -> Column:
    """The question for a summary: the first 2000 characters of speech, ten topics, five decisions, five tasks."""
    some = lambda c, n: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), ", ")).otherwise("None")
    return F.concat(F.lit("Summarize this session.\nTranscript: "), F.substring(head, 1, 2000), F.lit("\nTopics: "), F.array_join(F.slice(topics, 1, 10), ", "), F.lit("\nDecisions: "), some(decisions, 5), F.lit("\nTasks: "), some(tasks, 5))
