"""Settings with their defaults; each may be set by an environment variable DOCFACTS_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Limits and choices of a run."""

    max_bytes: int = 2_000_000
    max_binary: int = 25_000_000
    min_chars: int = 40
    min_printable: float = 0.85
    attempts: int = 3
    repairs: int = 1
    base_delay: float = 0.5
    max_delay: float = 8.0
    timeout: float = 300.0
    page_budget: int = 25
    missing: str = "-"
    use_model: bool = True
    reader_mode: str = "auto"
    seed: int = 0
    temperature: float = 0.0

    @classmethod
    def from_env(cls) -> EngineConfig:
        found = {}
        for f in fields(cls):
            text = os.environ.get(f"DOCFACTS_{f.name.upper()}")
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.lower() in ("1", "true", "yes") if kind is bool else kind(text)
        return cls(**found)
