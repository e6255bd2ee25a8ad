"""Vectors of texts where no model is given: words hashed to places."""

from __future__ import annotations

import zlib


def hashed(texts: list[str], size: int = 256) -> list[list[float]]:
    """How often each text has words of each hash; texts with words in common are near each other."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in text.lower().split():
            v[zlib.crc32(word.encode()) % size] += 1.0
        out.append(v)
    return out
