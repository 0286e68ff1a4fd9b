"""Layered settings: defaults, then a JSON file, then the environment; deep-merged on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {"storage": {"type": "filesystem", "path": "kb"}, "search": {"limit": 50, "threshold": 0.5}, "audit": {"rotate_records": 1_000_000}, "analysis": {"max_file_bytes": 5 * 1024 * 1024}}
PREFIX = "QUILLGRAPH_"


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """over wins; mappings are merged, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def value(text: str) -> Any:
    """true, false, numbers and JSON as such; anything else as text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def from_environment(env: Mapping[str, str]) -> dict[str, Any]:
    """PREFIX_A__B=1 sets a.b."""
    out: dict[str, Any] = {}
    for name, text in env.items():
        if name.startswith(PREFIX):
            at = out
            *above, last = name[len(PREFIX) :].lower().split("__")
            for k in above:
                at = at.setdefault(k, {})
            at[last] = value(text)
    return out


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    layers = [DEFAULTS]
    if path and Path(path).exists():
        layers.append(json.loads(Path(path).read_text(encoding="utf-8")))
    layers.append(from_environment(os.environ if env is None else env))
    out: dict[str, Any] = {}
    for layer in layers:
        out = merge(out, layer)
    return out


def recommended(cores: int, memory_mb: int) -> dict[str, int]:
    """Three quarters of the cores as workers, two fifths of the memory as cache."""
    return {"workers": max(1, int(cores * 0.75)), "cache_mb": int(memory_mb * 0.4)}
