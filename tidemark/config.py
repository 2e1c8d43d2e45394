"""Configuration: defaults, an override file merged deep, paths from the environment. Passed explicitly, never global."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

# Defaults of the engine's parameters.
DEFAULTS: dict = {
    "paths": {"raw_dir": "data/raw", "processed_dir": "data/processed", "memory_dir": "data/memory"},
    "pipeline": {"frame_sampling_fps": 1, "scene_threshold": 0.2, "time_window_sec": 2.0, "skip_existing": False},
    "embeddings": {"dimension": 384},
    "allow_downloads": False,
}


def merged(base: Mapping, updates: Mapping) -> dict:
    """Deep merge; the right side wins, lists are replaced."""
    out = dict(base)
    for k, v in updates.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


@dataclass(frozen=True)
class Config:
    values: dict = field(default_factory=lambda: DEFAULTS)

    def __getitem__(self, path: str):
        at = self.values
        for part in path.split("."):
            at = at[part]
        return at


def load_config(path: str | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """Defaults, the YAML file at `path`, then TIDEMARK_RAW_DIR, TIDEMARK_PROCESSED_DIR, TIDEMARK_MEMORY_DIR and
    TIDEMARK_ALLOW_DOWNLOADS. A sampling rate that is not positive is an error."""
    env, values = os.environ if environ is None else environ, DEFAULTS
    if path is not None:
        import yaml

        values = merged(values, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    for name in ("raw_dir", "processed_dir", "memory_dir"):
        if env.get(f"TIDEMARK_{name.upper()}"):
            values = merged(values, {"paths": {name: env[f"TIDEMARK_{name.upper()}"]}})
    if env.get("TIDEMARK_ALLOW_DOWNLOADS", "").lower() in ("1", "true", "yes"):
        values = merged(values, {"allow_downloads": True})
    if not values["pipeline"]["frame_sampling_fps"] > 0:
        raise ValueError("frame_sampling_fps must be positive")
    return Config(values)
