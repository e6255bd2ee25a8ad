"""What several operators use: tables in the shared folder, word splitting, and 64-bit hashes of words and windows."""

from __future__ import annotations

import numpy as np
import xxhash

from lexivec.operators.scratch import scratch, tidied
from lexivec.operators.scratch import written as saved

__all__ = ["LOWER", "ODD", "WordHashes", "fresh", "mix", "saved", "scratch", "tidied", "window_hashes", "words_of"]


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as no column (in any case of letters) needs to be called so."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Lower case of A-Z alone; other bytes of UTF-8 stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8. Splitting bytes uses just these six white space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hash by word, of the family of a seed; forgets all beyond a bounded number of words."""

    MOST = 400_000

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


ODD = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.copy()
    x ^= x >> S30
    x *= M1
    x ^= x >> S27
    x *= M2
    x ^= x >> S31
    return x


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive word hashes, by doubling: log n steps."""
    if n < 1 or len(h) < n:
        return np.zeros(0, np.uint64)
    done: np.ndarray | None = None
    size, power, at = 1, mix(h + ODD), 0
    while True:
        if n & size:
            done = power[: len(h) - size + 1] if done is None else mix(done[: len(h) - at - size + 1] * ODD + power[at : len(h) - size + 1])
            at += size
        if at == n:
            return done
        power = mix(power[: len(power) - size] * ODD + power[size:])
        size *= 2
