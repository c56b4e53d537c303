"""Thresholds of the engine; a YAML file or a mapping may override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    """Ratios are to the page's modal font size unless they say otherwise."""

    outlier_ratio: float = 3.0
    row_tolerance: float = 0.3
    column_gap: float = 0.5
    word_space_ratio: float = 0.12
    intra_word_gap: float = 0.75
    drop_cap_rows: float = 2.0
    drop_cap_reach: float = 1.5
    default_size: float = 9.0
    fragment_rows: float = 3.0
    fragment_shift: float = 3.0
    body_preview_words: int = 100
    top_n: int = 20
    most_excluded: int = 15
    most_why_words: int = 40
    asked_why_words: int = 30
    least_shared_words: int = 2
    least_shared_ratio: float = 0.5
    bold_markers: tuple[str, ...] = ("bold", "black", "heavy", "semibold")
    italic_markers: tuple[str, ...] = ("italic", "oblique")
    window_seconds: int = 60
    requests_per_minute: int = 15
    tokens_per_minute: int = 250_000
    requests_per_day: int = 500


def load_config(path: str | None = None, values: dict[str, Any] | None = None, prefix: str = "PAGELINE_") -> Config:
    """Defaults, then a YAML file (where PyYAML is installed), then ``values``, then the environment (``PAGELINE_TOP_N=5``)."""
    found: dict[str, Any] = {}
    if path:
        import yaml

        with open(path) as f:
            found.update(yaml.safe_load(f) or {})
    found.update(values or {})
    known = {f.name: f for f in fields(Config)}
    for name, field in known.items():
        if (said := os.environ.get(prefix + name.upper())) is not None:
            found[name] = said
        if name in found:
            default = field.default
            found[name] = tuple(found[name].split(",") if isinstance(found[name], str) else found[name]) if isinstance(default, tuple) else type(default)(found[name])
    unknown = set(found) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(Config(), **found)
