"""Language-model scoring by cross-entropy difference.

Two bigram models, one of a target corpus and one of the whole table, are matched in all but their counts: one
vocabulary, one smoothing. Words and pairs of adjacent words are counted exactly, by hashes of 63 bits and one that tells pairs from words, over all words of
all documents; the vocabulary is all that occur, at any size. A document's score is the mean over its words and end of the target's loss less the background's; less is
more like the target.

A text is its words and an end mark, which belongs to the vocabulary. After a word w, a model gives x the probability
WEIGHT * n(w, x) / n(w) + (1 - WEIGHT) * (n(x) + ADDED) / (N + ADDED * V), which sums to 1 over the vocabulary; the first
word, and what follows a word that the model hasn't seen, has the second fraction alone. A document is scored by models without
itself: its own counts are taken off (of the target's only if it belongs to it), so that a text's score tells what the
rest of the corpus says of it.

Rows are written once with their membership and cut into blocks of some BLOCK bytes of text as tasks read them, so equal
ids and equal texts need not meet. A block sends its distinct words and pairs by the first PREFIX bits of their hashes,
one row a prefix, so rows grow with the text and not with its square. Rows are sorted by prefix; prefixes are added up one
after another, some at once, and each block gets its counts back in the order of its hashes. A prefix holds a 65,536th of
what all blocks have: some 300 KB at 30 GB, 1 GB at 100 TB. Nothing goes to the driver but three sums.

Defined results: words are [^\\x20\\x09-\\x0D]+, A-Z in lower case; a null text has none; without words the losses and
the score are null; if no other document is a target, the target's model is uniform; rows repeated count
repeatedly, and each is scored without itself alone; very long texts count like others; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import LOWER, ODD, WordHashes, mix, saved, tidied

#: Weight of the pair's share; added to each word's count.
WEIGHT, ADDED = 0.6, 0.1
#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 24_000_000
#: Bits of a hash by which counts are dealt, and bytes of hashes that are added up at once.
PREFIX, AT_ONCE = 16, 16_000_000
LOW = np.uint64(64 - PREFIX)
LOW_BYTES = (64 - PREFIX) // 8

MESSAGE = "prefix int, block long, low binary, n binary, t binary"
MESSAGE_ARROW = pa.schema([("prefix", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
NUMBERED = "block long, doc_id long, member boolean, words binary"
NUMBERED_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("member", pa.bool_()), ("words", pa.binary())])
ANSWER = "block long, prefix int, n binary, t binary, n_words long, t_words long, distinct long"
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("prefix", pa.int32()), ("n", pa.binary()), ("t", pa.binary()), ("n_words", pa.int64()), ("t_words", pa.int64()), ("distinct", pa.int64())])
SCORED = "doc_id long, n_words long, loss_target double, loss_background double, score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()), ("score", pa.float64())])


#: Stands for a word's hash at the end of a text.
FINISH = np.uint64(0x5851F42D4C957F2C)
#: Hashes of words are even, those of pairs odd.
PAIR = np.uint64(1)


def slots(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of a text's words and its end."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    return np.append(cache.of(words) & ~PAIR, FINISH) if words else np.zeros(0, np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes: those that are all but zero compress to nothing."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass
class Block:
    """A block's documents: lengths in words and ends; the number of each word; distinct pairs of numbers in order, and
    which of them each word but the first of a document is with the one before it."""

    lengths: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, word: np.ndarray) -> Block:
        after = ~cls.starts(lengths)
        both = (word[:-1].astype(np.uint64) << np.uint64(32) | word[1:].astype(np.uint64))[after[1:]]
        return cls(lengths, word, *np.unique(both, return_inverse=True))

    @staticmethod
    def starts(lengths: np.ndarray) -> np.ndarray:
        """Whether each word is the first of its document."""
        out = np.zeros(int(lengths.sum()), bool)
        out[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return out

    def counts(self, member: np.ndarray | None = None) -> np.ndarray:
        """How often each distinct word, then each distinct pair, occurs in the documents, or in those that are members."""
        of_word = np.repeat(np.ones(len(self.lengths), bool) if member is None else member, self.lengths)
        words = int(self.word.max(initial=-1)) + 1
        return np.concatenate([np.bincount(self.word[of_word], minlength=words), np.bincount(self.pair[of_word[~self.starts(self.lengths)]], minlength=len(self.pairs))])

    def own(self, at: np.ndarray, document: np.ndarray) -> np.ndarray:
        """How often each item's document has it."""
        _, back, n = np.unique(document * (int(at.max(initial=0)) + 1) + at, return_inverse=True, return_counts=True)
        return n[back]

    def losses(self, counts: np.ndarray, total: int, vocabulary: int, member: np.ndarray) -> np.ndarray:
        """Loss of each word after the one before it, by a model's counts of the distinct words and pairs, less those of
        the document itself if it is a member of the model's corpus."""
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        after, mine = ~self.starts(self.lengths), member[document]
        words, pairs = counts[: len(counts) - len(self.pairs)], counts[len(counts) - len(self.pairs) :]
        n = (words[self.word] - np.where(mine, self.own(self.word, document), 0)).astype(np.float64)
        both = pairs[self.pair] - np.where(mine[after], self.own(self.pair, document[after]), 0)
        p = (n + ADDED) / ((total - self.lengths * member)[document] + ADDED * vocabulary)
        seen = n[:-1][after[1:]]
        p[after] = np.where(seen > 0, WEIGHT * both / np.maximum(seen, 1) + (1 - WEIGHT) * p[after], p[after])
        return -np.log(p)


def cut(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of fixed numbers of bytes as binaries that end after so many rows."""
    offsets = np.append(0, ends).astype(np.int32) * np.int32(x.itemsize * x[0].size)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def hashes_of(words: np.ndarray, found: Block) -> np.ndarray:
    """Hashes of a block's distinct words, then of its distinct pairs."""
    first, second = (words[(found.pairs >> np.uint64(k)) & np.uint64(0xFFFFFFFF)] for k in (32, 0))
    return np.concatenate([words, mix(first * ODD + second) | PAIR])


def messages(block: int, ids: list, members: list[bool], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """A block's distinct words and pairs with their counts, one row a prefix, both in order."""
    words, word = np.unique(np.concatenate(hashes), return_inverse=True)
    found = Block.of(np.array([len(h) for h in hashes], np.int64), word)
    keys = hashes_of(words, found)
    if not len(keys):
        return pa.RecordBatch.from_pylist([], MESSAGE_ARROW)
    order = np.argsort(keys)
    keys = keys[order]
    prefix = (keys >> LOW).astype(np.int32)
    ends = np.append(np.flatnonzero(np.diff(prefix)) + 1, len(keys))
    n, t = (found.counts(of)[order].astype(np.uint32) for of in (None, np.array(members)))
    low = keys.view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]
    return pa.RecordBatch.from_arrays([pa.array(prefix[ends - 1]), pa.array(np.full(len(ends), block)), cut(low, ends), cut(n, ends), cut(t, ends)], schema=MESSAGE_ARROW)


def numbered(block: int, ids: list, members: list[bool], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """A block's documents as numbers of its distinct words, and a row with their hashes (member null)."""
    words, word = np.unique(np.concatenate(hashes), return_inverse=True)
    each = np.split(word.astype(np.uint32), np.cumsum([len(h) for h in hashes])[:-1])
    cols = [[block] * (len(ids) + 1), [*ids, None], [*members, None], [*map(planes, each), words.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, NUMBERED_ARROW)], schema=NUMBERED_ARROW)


def blocks(rows: DataFrame, make: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What is made of each block of rows (doc_id, member, text), a written table. Blocks are numbered by the task that
    reads them, so that each scan of the same files makes the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        block, size, held = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            for doc_id, member, text in zip(batch["doc_id"].to_pylist(), batch["member"].to_pylist(), batch["text"]):
                text = text.as_py()
                for part, value in zip(held, (doc_id, member, slots(text, cache))):
                    part.append(value)
                size += len(text or "")
                if size >= BLOCK:
                    yield make(block, *held)
                    block, size, held = block + 1, 0, ([], [], [])
        if held[0]:
            yield make(block, *held)

    return rows.select("doc_id", "member", "text").mapInArrow(run, schema)


def added_up(told: DataFrame) -> DataFrame:
    """Counts over all blocks for each message, as planes of numbers, and rows (block null) with sums over words: all,
    the target's, distinct ones."""

    def add(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        lows = [x.as_py() for x in rows["low"]]
        sizes = np.array([len(x) // LOW_BYTES for x in lows])
        keys = np.zeros((int(sizes.sum()), 8), np.uint8)
        keys[:, :LOW_BYTES] = np.frombuffer(b"".join(lows), np.uint8).reshape(-1, LOW_BYTES)
        keys = keys.view(np.uint64).ravel() | np.repeat(rows["prefix"].to_numpy().astype(np.uint64), sizes) << LOW
        distinct, at = np.unique(keys, return_inverse=True)
        word = distinct & PAIR == 0
        cols, sums = [rows["block"].to_pylist(), rows["prefix"].to_pylist()], []
        for name in ("n", "t"):
            own = np.frombuffer(b"".join(x.as_py() for x in rows[name]), np.uint32)
            total = np.bincount(at, own, len(distinct)).astype(np.uint64)
            cols.append([planes(x) for x in np.split(total[at], np.cumsum(sizes)[:-1])])
            sums.append(int(total[word].sum()))
        nothing = [None] * rows.num_rows
        whole = [[*c, last] for c, last in zip([*cols, nothing, nothing, nothing], [None, None, None, None, *sums, int(word.sum())])]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(whole, ANSWER_ARROW)], schema=ANSWER_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            prefix = batch["prefix"].to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist()]
            for k, start in enumerate(starts):
                if size >= AT_ONCE and (k or held[-1]["prefix"][-1].as_py() != prefix[0]):
                    yield from add(held)
                    held, size = [], 0
                some = batch.slice(start, (starts[k + 1] if k + 1 < len(starts) else len(prefix)) - start)
                size += pc.sum(pc.binary_length(some["low"])).as_py()
                held.append(some)
        if held:
            yield from add(held)

    return told.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, ANSWER)


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score of every document; the target is those whose doc_id is in target."""
    with tidied(docs.sparkSession) as keep:
        return keep(saved(scored(docs, target), "scores"))


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    # Labels grow with the documents: they are written once an id, so that Spark knows their size when it chooses the join.
    marks = saved(target.select(F.col("doc_id").cast("long").alias("marked")).where("marked is not null").distinct(), "marks")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(marks, F.col("doc_id") == F.col("marked"), "left")
    rows = saved(rows.select("doc_id", "text", F.col("marked").isNotNull().alias("member")), "texts")
    answers = saved(added_up(blocks(rows, messages, MESSAGE)), "counts")
    sums = answers.where("block is null").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("distinct", "t_words", "n_words")])
    vocabulary, *totals = sums.first()

    def judge(texts: pa.Table, sums: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return SCORED_ARROW.empty_table()
        words = np.frombuffer(texts.filter(pc.is_null(texts["member"]))["words"][0].as_py(), np.uint64)
        texts = texts.filter(pc.is_valid(texts["member"]))
        numbers = [unplaned(x.as_py(), np.uint32) for x in texts["words"]]
        block = Block.of(np.array([len(x) for x in numbers], np.int64), np.concatenate(numbers).astype(np.int64))
        order = np.argsort(hashes_of(words, block))
        sums = sums.sort_by("prefix")
        member = texts["member"].to_numpy()
        losses = []
        for name, total, of in zip("tn", totals, (member, np.ones(len(member), bool))):
            counts = np.zeros(len(order), np.int64)
            counts[order] = np.concatenate([unplaned(x.as_py(), np.uint64) for x in sums[name]] or [np.zeros(0, np.uint64)])
            losses.append(block.losses(counts, total, vocabulary, of))
        cuts = np.cumsum(block.lengths)[:-1]
        means = [[float(x.mean()) if len(x) else None for x in np.split(v, cuts)] for v in (*losses, losses[0] - losses[1])]
        return pa.table([texts["doc_id"].combine_chunks(), np.maximum(block.lengths - 1, 0), *(pa.array(m, pa.float64()) for m in means)], SCORED_ARROW)

    asked = answers.where("block is not null").select("block", "prefix", "n", "t")
    return blocks(rows, numbered, NUMBERED).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(judge, SCORED)
