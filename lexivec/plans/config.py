"""Settings with types and defaults, from the environment or a named bundle."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from lexivec.operators.legacy import PRESETS

TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Config:
    """chunk_size, chunk_overlap: windows of passages. top_k: records of an answer. semantic: weight of the cosine in the
    older ranking. provider, model: who answers and who embeds. interval_minutes: between batches. retries,
    retry_delay: of a document's fetch. only_open: whether closed records are left out."""

    chunk_size: int = 800
    chunk_overlap: int = 100
    top_k: int = 5
    semantic: float = 0.6
    provider: str = ""
    model: str = ""
    interval_minutes: int = 60
    retries: int = 3
    retry_delay: float = 5.0
    only_open: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "LEXIVEC_") -> Config:
        """Values of PREFIX + NAME where they are set; a value that its type can't read raises ValueError."""
        env = os.environ if env is None else env
        read = {"int": int, "float": float, "str": str, "bool": lambda v: v.strip().lower() in TRUE}
        return cls(**{f.name: read[str(f.type)](env[key]) for f in fields(cls) if (key := prefix + f.name.upper()) in env})

    def preset(self, name: str) -> Config:
        """With the values of a bundle: precision, recall, balanced or speed."""
        p = PRESETS[name]
        return replace(self, chunk_size=p["chunk_size"], chunk_overlap=p["overlap"], top_k=p["top_k"], semantic=p["semantic"])
