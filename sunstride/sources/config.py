"""Run configuration: a nested mapping over defaults, and its hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

DEFAULTS = {
    "data": {"path": None, "history_minutes": 60, "history_step_minutes": 15, "horizon_minutes": 15},
    "split": {"strategy": "holdout", "validation_fraction": 0.1, "seed": 42},
    "strides": {"train": 30, "validation": 15, "test": 15},
    "scaler": "identity",
    "model": {"name": "persistence", "preset": "default"},
    "output": {"path": None},
}


def flat(tree: dict, above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """(path, value) of each value that is no mapping, and of each empty one."""
    for k, v in tree.items():
        yield from flat(v, (*above, k)) if isinstance(v, dict) and v else [((*above, k), v)]


def nested(values: dict[tuple[str, ...], object]) -> dict:
    out: dict = {}
    for path, v in values.items():
        at = out
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = v
    return out


def merged(over: dict | None, base: dict = DEFAULTS) -> dict:
    """The values of both by their paths. A given value replaces what lies at or below its path, an explicit null too; an empty mapping over a mapping says nothing."""
    given = dict(flat(over or {}))
    heads = {p[:n] for p in given for n in range(1, len(p))}
    kept = {p: v for p, v in flat(base) if p not in heads and not any(p[:n] in given and given[p[:n]] != {} for n in range(1, len(p) + 1))}
    return nested(kept | {p: v for p, v in given.items() if v != {} or not any(q[: len(p)] == p for q in kept)})


def read(path: str) -> dict:
    """A mapping from JSON, or YAML where that library is there."""
    with open(path) as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def load(path: str) -> dict:
    return merged(read(path))


def digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
