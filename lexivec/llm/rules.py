"""Rule statistics of texts: one narrow pass over whole texts, from which quality operators start.

Words are [^\\x20\\x09-\\x0D]+. Defined results: a null or empty text has zeros everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import WordHashes, window_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "log_words", "mean_word", "spread_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "punctuation_share", "mark_share", "bar_share", "other_share", "short_share", "words_a_line", "byte_entropy",
]
ASCII = np.arange(256)
UPPER = (ASCII >= 65) & (ASCII <= 90)
LETTER = UPPER | (ASCII >= 97) & (ASCII <= 122) | (ASCII >= 128)
DIGIT = (ASCII >= 48) & (ASCII <= 57)
SPACE = np.isin(ASCII, list(BLANKS.encode()))
PLAIN = np.isin(ASCII, list(b".,;:'\"()-"))
MARK = np.isin(ASCII, list(b"!?"))
BAR = np.isin(ASCII, list(b"|"))
CLASSES = np.stack([LETTER, UPPER, DIGIT, PLAIN, MARK, BAR, SPACE]).astype(np.float64)


def repeated_words(hashes: np.ndarray, n: int = 3) -> int:
    """Words in windows of n words that are found twice or more."""
    t = window_hashes(hashes, n)
    if len(t) < 2:
        return 0
    order = np.argsort(t)
    same = t[order[1:]] == t[order[:-1]]
    hit = np.zeros(len(t), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(n):
        covered[k : k + len(t)] |= hit
    return int(covered.sum())


def statistics(text: str | None, cache: WordHashes) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of a text."""
    if not text:
        return [0] * len(COUNTS), [0.0] * len(RATIOS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    h = cache.of(words)
    repeat = repeated_words(h)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letter, upper, digit, plain, mark, bar, space = (CLASSES @ seen).tolist()
    solid = max(len(raw) - space, 1)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    p = seen[seen > 0] / len(raw)
    ratios = [
        np.log1p(n), lengths.mean(), lengths.std(), symbols / max(chars, 1), dup / max(len(lines), 1), repeat / max(n, 1), len(np.unique(h)) / max(n, 1), upper / solid,
        digit / solid, plain / solid, mark / solid, bar / solid, (solid - letter - digit - plain - mark - bar) / solid, (lengths <= 3).mean(), np.log1p(n / max(len(lines), 1)), -(p * np.log2(p)).sum(),
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in ratios]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS (long) and RATIOS (array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows = [statistics(t.as_py(), cache) for t in batch["text"]]
            counts = np.array([c for c, _ in rows], np.int64).reshape(len(rows), len(COUNTS))
            flat = pa.array(np.array([r for _, r in rows], np.float64).reshape(-1))
            ends = pa.array(np.arange(len(rows) + 1) * len(RATIOS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in counts.T), pa.ListArray.from_arrays(ends, flat)], ["doc_id", *COUNTS, "ratios"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", ratios array<double>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def ratios(text: str) -> Column:
    """RATIOS (array<double>) of a text column."""

    def run(texts: pa.Array) -> pa.Array:
        cache = WordHashes()
        flat = np.array([statistics(t.as_py(), cache)[1] for t in texts], np.float64).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(RATIOS), pa.int32()), pa.array(flat))

    return F.arrow_udf(run, "array<double>")(F.col(text).cast("string"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(lists) else np.zeros((0, width))
