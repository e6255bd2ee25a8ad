"""Harmonic packing of token ids into sequences of one capacity.

Lengths fall into classes by the reciprocals of the capacity C: the class of k holds documents of more than C / (k + 1)
and at most C / k tokens, and its sequences take k of them, whatever their lengths. Every class has one open sequence
in each worker; workers need nothing of each other, so there is no shuffle.

k documents leave less than C / (k + 1) of their sequence free. That is filled by cutting few documents: those of more
than C tokens, which can't stay whole, are held (at most SPARE sequences of them; beyond, whole sequences are cut off and the rest goes
to its class) and give what is free its tokens. Where none is held, WAITING sequences wait for one, and beyond that the next document is cut.
What a worker holds at its end is poured into sequences one after another, so that only its last one is padded.

Ids come from tiktoken with the ranks of the vocabulary file; what its regular expressions can't take, such as a million
blanks in a row, goes to lexivec.llm.bpe. Both give the ids of the tokenizers library. Defined results: a null or empty text is one token, the end mark; equal rows are
packed each by itself; an empty table gives no pieces; a null doc_id stays null; very long texts and runs of blanks are
cut like others. Columns besides doc_id and text take no part.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.bpe import byte_letters, default_path, load

#: The pattern of byte-level tokenizers of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequences that wait for filling, and sequences of tokens that are held to fill them: bounds of a worker's memory.
WAITING = SPARE = 256
#: Pieces that leave a worker together.
ROWS = 20_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary of a tokenizers file whose ids follow its merges, in a faster library."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("the ids of this vocabulary don't follow its merges")
    ranks = {bytes(letters[c] for c in s): i for s, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(text: str, path: str) -> bytes:
    """Ids of a text, as little-endian unsigned 32-bit numbers."""
    try:
        return np.array(encoder(path).encode(text, allowed_special="all"), "<u4").tobytes()
    except ValueError:  # its regular expressions ran out of stack
        return load(path).encode_batch([text])[0]


def class_of(n: int, capacity: int) -> int:
    """How many documents of n tokens (at most the capacity) share a sequence."""
    return capacity // n


class Bins:
    """The open sequences of one worker. A piece is (doc_id, ids of the document, start, length)."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.waiting: deque[tuple[list[tuple], int]] = deque()
        self.spare: deque[tuple] = deque()
        self.spare_tokens = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, ids, start, n in pieces:
            self.rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, self.next_id, at))
            at += n
        self.next_id += 1

    def take(self, most: int) -> tuple:
        """Up to so many tokens from the front of what is held."""
        doc_id, ids, start, n = self.spare.popleft()
        got = min(n, most)
        if got < n:
            self.spare.appendleft((doc_id, ids, start + got, n - got))
        self.spare_tokens -= got
        return doc_id, ids, start, got

    def hold(self, piece: tuple) -> None:
        self.spare.append(piece)
        self.spare_tokens += piece[3]

    def place(self, piece: tuple) -> None:
        """Put a piece of at most the capacity into its class; close or line up the sequence if that was the last."""
        k = class_of(piece[3], self.capacity)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            if free := self.capacity - sum(p[3] for p in held):
                self.waiting.append((held, free))
            else:
                self.close(held)

    def fill(self) -> None:
        while self.waiting and self.spare:
            held, free = self.waiting.popleft()
            held.append(piece := self.take(free))
            if free > piece[3]:
                self.waiting.appendleft((held, free - piece[3]))
            else:
                self.close(held)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        piece = (doc_id, ids, 0, n := len(ids) // 4)
        if n > self.capacity or len(self.waiting) >= WAITING:
            self.hold(piece)
        else:
            self.place(piece)
        self.fill()
        while self.spare_tokens > SPARE * self.capacity:
            self.place(self.take(self.capacity))

    def end(self) -> None:
        for held in self.open.values():
            for piece in held:
                self.hold(piece)
        self.open = {}
        self.fill()
        while self.spare:  # nothing waits any longer
            self.waiting.append(([], self.capacity))
            self.fill()
        for held, _ in self.waiting:
            self.close(held)
        self.waiting.clear()


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id (unique over all workers) and offset in the sequence."""
    if capacity < 1:
        raise ValueError("capacity must be 1 at least")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId() << 32)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                bins.add(doc_id, ids_of(text.as_py() or "", path) + end)
                if len(bins.rows) >= ROWS:
                    yield batch_of(bins.rows)
                    bins.rows = []
        bins.end()
        yield batch_of(bins.rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
