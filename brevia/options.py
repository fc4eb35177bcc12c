"""Settings of a compaction run: a frozen object whose fields become literals of the plan."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Share of sentences kept at each level; an unknown level counts as balanced.
KEEP_RATIOS = {"light": 0.70, "balanced": 0.45, "aggressive": 0.25}


@dataclass(frozen=True)
class Options:
    enabled: bool = True
    level: str = "balanced"
    min_tokens: int = 300
    redact_secrets: bool = True
    tokenizer: str = "heuristic"
    vocabulary: str | None = None  # a file of ranks that every executor has, for other tokenizers
    model: str = "default"
    store_dir: str = ".brevia/store"
    store_ttl: int = 86_400
    reversible: bool = True
    quality_threshold: float = 0.35
    dedup: bool = True
    normalize_whitespace: bool = True
    price_per_mtok: float | None = None
    marker: str = "brevia:ref"
    redact_outputs: bool = False

    @property
    def keep_ratio(self) -> float:
        return KEEP_RATIOS.get(self.level, KEEP_RATIOS["balanced"])

    def merged(self, **overrides) -> Options:
        """A copy with the overrides that aren't None."""
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None, prefix: str = "BREVIA_") -> Options:
        """Defaults, replaced by environment variables that parse; others are passed over."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(Options):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            try:
                found[f.name] = _parse(raw, getattr(Options(), f.name), f.name)
            except ValueError:
                continue
        return Options(**found)


def _parse(raw: str, default, name: str):
    if isinstance(default, bool):
        return raw.strip().lower() in {"1", "true", "yes", "on"}
    if isinstance(default, int):
        return int(raw)
    if isinstance(default, float) or name == "price_per_mtok":
        return float(raw)
    return raw
