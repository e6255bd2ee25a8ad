"""Byte-level BPE encoding and decoding: speculate, verify, and merge only what fails.

* Speculation: a word's bytes are cut by greedy longest match over the vocabulary.
* Verification: a cut is the BPE result exactly if every two adjacent tokens are compatible, that is, if
  no merge across their border would have come before the merges inside them. All adjacent pairs of all new
  words of an Arrow batch are tested together with numpy.
* Only words with an incompatible pair go through exact merging.

Texts are cut into chunks at blanks, and Arrow tells the distinct ones of a block apart; only those are looked at, so that
Python's work is by distinct chunk and all else is gathering. Chunks and words that were seen before come from two
caches of bounded bytes (``CACHE_BYTES``). Short words are proposed and merged in step, long ones one by one: the results are the
same. Work is a narrow map: no shuffle, one Arrow batch in memory at a time.

Defined results: a null text counts as the empty text; an empty text has no ids; the text of the special token
becomes its id; ids outside the vocabulary can't be decoded and raise an error; ill-formed UTF-8 that results from
decoding becomes U+FFFD, as in the library that this one follows. Other columns of the table pass unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Bytes of either cache (words, chunks of text); characters of the longest text in it.
CACHE_BYTES, LONGEST = 96_000_000, 64
#: Words that are learned together; bytes of texts that are encoded together.
SLICE, BLOCK = 50_000, 12_000_000
#: Above every rank.
NONE = 1 << 40
#: The pattern of byte-level tokenizers of this family; white space by its Unicode property.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space of one byte, and by its first byte the rest of that of more bytes.
WHITE = np.isin(np.arange(256), [*range(9, 14), 32])
WIDE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_TAILS = {lead: [c[1:] for x in WIDE if (c := chr(x).encode())[0] == lead] for lead in (0xC2, 0xE1, 0xE2, 0xE3)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes | None] = [None] * self.size
        self.id_of: dict[bytes, int] = {}
        for s, i in vocab.items():
            self.bytes_of[i] = raw(s)
            self.id_of[self.bytes_of[i]] = i
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        #: By a token's first three bytes, the lengths of such tokens, the longest first; shorter ones after them.
        lengths: dict[bytes, set[int]] = {}
        for t in self.id_of:
            lengths.setdefault(t[:3], set()).add(len(t))
        self.lengths = {t: tuple(sorted(ks | {1, 2}, reverse=True)) for t, ks in lengths.items() if len(t) == 3}
        #: (left, right) -> rank of their merge, and by rank the merged token.
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        #: By token: the rank of the merge that makes it (-1: a byte) and that merge's two sides.
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank_of.setdefault((x, y), k)
            self.made.append(z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
        keys = np.array([x * self.size + y for x, y in self.rank_of], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array([*self.rank_of.values()], np.int64)[order], NONE)
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.trie_keys, self.trie_next, self.trie_token = self.trie()
        self.find = regex.compile(WORD).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.token_bytes = pa.array(self.bytes_of, pa.binary())
        self.token_decimals = pa.array([None if t is None else b"%d," % i for i, t in enumerate(self.bytes_of)], pa.binary())
        self.words, self.chunks = Known(CACHE_BYTES), Known(CACHE_BYTES)

    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vocabulary as a trie: sorted keys node * 256 + byte, the nodes they lead to, and nodes' tokens."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        for t in self.id_of:
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(nodes)
                    edges.append((nodes[t[: k - 1]] * 256 + t[k - 1], nodes[t[:k]]))
        edges.sort()
        token = np.full(len(nodes), -1, np.int64)
        for t, i in self.id_of.items():
            token[nodes[t]] = i
        keys, following = np.array(edges, np.int64).T
        return np.append(keys, np.iinfo(np.int64).max), np.append(following, 0), token

    # -- words

    def longest_match(self, word: bytes) -> list[int]:
        """Greedy cut of a word's bytes, the longest token first."""
        out, i, n, id_of, lengths = [], 0, len(word), self.id_of, self.lengths
        while i < n:
            for k in lengths.get(word[i : i + 3], (2, 1)):
                if (t := id_of.get(word[i : i + k])) is not None:
                    break
            out.append(t)
            i += len(self.bytes_of[t])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, from the left among equals."""
        if len(word) > 48:
            return self.merge_long(word)
        rank_of, made = self.rank_of, self.made
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        ranks = [rank_of.get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks:
            k = min(ranks)
            if k == NONE:
                break
            i = ranks.index(k)
            ids[i : i + 2] = [z] = [made[k]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of.get((z, ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank_of.get((ids[i - 1], z), NONE)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same by a heap: n log n in the word's length."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n, rank_of, made = len(ids), self.rank_of, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := rank_of.get((ids[i], ids[i + 1]), NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, _ = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := rank_of.get((z, ids[k]), NONE)) < NONE:
                    heapq.heappush(heap, (m, i, z, ids[k]))
            if (h := before[i]) >= 0 and (m := rank_of.get((ids[h], z), NONE)) < NONE:
                heapq.heappush(heap, (m, h, ids[h], z))
        return [t for t in ids if t >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between adjacent tokens a and b is left alone by every merge that comes in time.

        Undo the later of the two tokens' last merges again and again; at each step the tokens that touch the
        border must not have a merge that comes before the merge just undone. On equal ranks the border's
        pair comes first if it stands to the left, that is, if the right token was the one undone.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), NONE, np.int64)
        while len(at):
            keys = a * self.size + b
            k = np.searchsorted(self.pair_keys, keys)
            crossing = np.where(self.pair_keys[k] == keys, self.pair_rank[k], NONE)
            bad = crossing < limit
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, at = a[go], b[go], ra[go], rb[go], at[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def propose(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """longest_match of many words in step, by a walk down the trie: tokens, and the number of them by word."""
        data = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        stop = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        word = np.flatnonzero(np.diff(stop, prepend=0) > 0)
        at = (stop - np.diff(stop, prepend=0))[word]
        end = stop[word]
        node, best, best_at = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64), at.copy()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            inside = at < end
            key = node * 256 + data[np.minimum(at, end - 1)]
            k = np.searchsorted(self.trie_keys, key)
            go = inside & (self.trie_keys[k] == key)
            node = np.where(go, self.trie_next[k], 0)
            at = np.where(go, at + 1, best_at)
            token = self.trie_token[node]
            found = go & (token >= 0)
            best, best_at = np.where(found, token, best), np.where(found, at, best_at)
            done = ~go
            if done.any():
                out.append((word[done], best[done]))
                best[done] = -1
                left = ~(done & (at >= end))
                if not left.all():
                    word, at, end, node, best, best_at = (x[left] for x in (word, at, end, node, best, best_at))
        if not out:
            return np.zeros(0, np.int64), np.zeros(len(raws), np.int64)
        words, tokens = (np.concatenate(x) for x in zip(*out))
        return tokens[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(raws))

    def rank_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        k = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[k] == keys, self.pair_rank[k], NONE)

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """merge() of many short words in step; the ids of each in bytes."""
        width = max(map(len, raws))
        x = np.full((len(raws), width + 1), -1, np.int64)
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        x[:, :-1][np.arange(width) < n[:, None]] = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        ranks = self.rank_pairs(x[:, :-1], x[:, 1:])
        rows = np.arange(len(raws))
        final = np.full((len(raws), width), -1, np.int64)
        made = np.array(self.made)
        while len(rows):
            i = ranks.argmin(1)
            here = np.arange(len(rows))
            low = ranks[here, i]
            on = low < NONE
            final[rows[~on]] = x[~on, :-1]
            x, ranks, rows, i, low = x[on], ranks[on], rows[on], i[on], low[on]
            here = np.arange(len(rows))
            x[here, i] = made[low]
            later = np.arange(width)[None, :] > i[:, None]
            x[:, :-1] = np.where(later, x[:, 1:], x[:, :-1])
            ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ranks[here, i] = self.rank_pairs(x[here, i], x[here, i + 1])
            before = np.flatnonzero(i > 0)
            j = i[before]
            ranks[before, j - 1] = self.rank_pairs(x[before, j - 1], x[before, j])
        keep = final >= 0
        flat, ends = final[keep].astype("<u4").tobytes(), (4 * keep.sum(1).cumsum()).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        words = sorted(words, key=len)
        raws = [w.encode() for w in words]
        short = np.searchsorted(np.fromiter(map(len, words), np.int64, len(words)), 100, side="right")
        flat, n = self.propose(raws[:short])
        if short < len(raws):
            cuts = [self.longest_match(r) for r in raws[short:]]
            flat, n = np.append(flat, np.concatenate(cuts)), np.append(n, [len(c) for c in cuts])
        ends = np.cumsum(n)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        at = np.flatnonzero(inner)
        failing = at[~self.compatible(flat[at], flat[at + 1])]
        data, starts = flat.astype("<u4").tobytes(), ends - n
        out = {w: data[i:j] for w, i, j in zip(words, (4 * starts).tolist(), (4 * ends).tolist())}
        again = np.unique(np.searchsorted(ends, failing, side="right")).tolist()
        few = [k for k in again if len(raws[k]) <= 32]
        for i in range(0, len(few), 4096):
            for k, x in zip(few[i : i + 4096], self.merge_many([raws[k] for k in few[i : i + 4096]])):
                out[words[k]] = x
        for k in again:
            if len(raws[k]) > 32:
                out[words[k]] = np.array(self.merge(raws[k]), "<u4").tobytes()
        return out

    # -- texts

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk of text."""
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        return self.find(chunk)

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, by SLICE of them: from those known, or learned."""
        out: list[bytes] = []
        for i in range(0, len(words), SLICE):
            part = words[i : i + SLICE]
            held = self.words.some(part)
            if new := [w for w in dict.fromkeys(part) if w not in held]:
                learned = self.learn(new)
                self.words.add(learned)
                held |= learned
            out += map(held.__getitem__, part)
        return out

    def ids_of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, those known and those cut into words."""
        held = self.chunks.some(chunks)
        if len(held) < len(chunks):
            new = [c for c in chunks if c not in held]
            cut = [self.pieces(c) for c in new]
            ids = self.ids_of_words([w for ws in cut for w in ws])
            at, learned = 0, {}
            for c, ws in zip(new, cut):
                learned[c] = ids[at] if len(ws) == 1 else b"".join(ids[at : at + len(ws)])
                at += len(ws)
            self.chunks.add(learned)
            held |= learned
        return [held[c] for c in chunks]

    def encode_plain(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of texts without special tokens. Their chunks are told apart by Arrow, each distinct one is encoded
        once, and ids are gathered from those of the distinct ones."""
        texts = pa.concat_arrays([texts])  # offsets from zero
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
        buffer = texts.buffers()[2]
        n = int(offsets[-1])
        if not n:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        starts = np.append(borders(np.frombuffer(buffer, np.uint8)[:n], offsets), n)
        chunks = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), buffer).dictionary_encode()
        lists = as_lists(self.ids_of_chunks(chunks.dictionary.to_pylist())).take(chunks.indices)
        ends = lists.offsets.to_numpy()[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(ends), lists.values)

    def parts(self, text: str) -> list[str]:
        """A text as texts and special tokens in turn."""
        out, end = [], 0
        for m in self.cut.finditer(text):
            out += [text[end : m.start()], m[0]]
            end = m.end()
        return [*out, text[end:]]

    def encode_texts(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of texts of any kind, none of them null."""
        marked = np.zeros(len(texts), bool)
        for s in self.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.encode_plain(texts)
        parts, counts = [], []
        for text, cut in zip(texts.to_pylist(), marked.tolist()):
            parts += (got := self.parts(text) if cut else [text])
            counts.append(len(got))
        tokens = [self.special.get(p) for p in parts]
        plain = self.encode_plain(pa.array(["" if t is not None else p for p, t in zip(parts, tokens)], pa.string()))
        lists = pa.concat_arrays([plain, as_lists([np.array([t], "<i4").tobytes() for t in self.special.values()])])
        place = {t: len(plain) + k for k, t in enumerate(self.special.values())}
        lists = lists.take(pa.array([k if t is None else place[t] for k, t in enumerate(tokens)]))
        ends = lists.offsets.to_numpy()[np.cumsum([0, *counts])]
        return pa.ListArray.from_arrays(pa.array(ends), lists.values)

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Ids of texts (null: empty), by blocks of bounded size."""
        done = [self.encode_texts(block) for block in blocks(texts.cast(pa.string()).fill_null(""))]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, each as little-endian 32-bit numbers."""
        lists = self.encode_array(pa.array(texts, pa.string()))
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
        return [flat[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode_array(self, lists: pa.ListArray) -> pa.StringArray:
        """Texts of lists of ids; null for null."""
        data = joined(lists, self.token_bytes)
        try:
            return data.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in data.to_pylist()], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_array(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decimals_of(self, lists: pa.ListArray) -> pa.BinaryArray:
        """Lists of ids as decimal numbers, each with a comma after it."""
        return joined(lists, self.token_decimals)


class Known(dict):
    """Ids by text. Never holds more than about so many bytes: what comes when it is full isn't kept, and the next
    that asks finds it empty. Long texts aren't kept either."""

    #: Bytes of an entry besides its text and ids.
    ENTRY = 180

    def __init__(self, most: int) -> None:
        self.most, self.size, self.full = most, 0, False

    def some(self, texts: list[str]) -> dict[str, bytes]:
        """The known ones among texts."""
        if self.full:
            self.clear()
            self.size, self.full = 0, False
        get = self.get
        return {t: x for t in texts if (x := get(t)) is not None}

    def add(self, ids: dict[str, bytes]) -> None:
        for t, x in ids.items():
            if len(t) <= LONGEST:
                self.size += 4 * len(t) + len(x) + self.ENTRY
                if self.size > self.most:
                    self.full = True
                    return
                self[t] = x


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts (UTF-8 bytes between offsets) begin, and where they may be cut, as the pattern finds the same words on
    both sides: before a blank that no white space follows, and on both sides of a single line feed between others."""
    n = len(data)
    white = WHITE[data]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        for tail in WHITE_TAILS[lead]:
            hit = at[at + len(tail) < n]
            for k, b in enumerate(tail, 1):
                hit = hit[data[hit + k] == b]
            for k in range(len(tail) + 1):
                white[hit + k] = True
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    open_after = np.append(~white[1:], False) & ~begins[1:]  # a character of the same text follows that isn't white
    cut = (data == 32) & open_after
    feeds = np.flatnonzero((data == 10) & open_after & ~begins[:-1])
    feeds = feeds[~white[feeds - 1]]
    cut |= begins[:-1]
    cut[feeds] = True
    cut[feeds + 1] = True
    return np.flatnonzero(cut)


def as_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def joined(lists: pa.ListArray, of: pa.BinaryArray) -> pa.BinaryArray:
    """For each list of ids the bytes of its members, one after another."""
    done = []
    for block in blocks(lists):
        ends = block.offsets.to_numpy()
        got = of.take(block.values.slice(ends[0], ends[-1] - ends[0]))
        if got.null_count:
            raise ValueError("an id without a token")
        at = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1][ends - ends[0]]
        done.append(pa.BinaryArray.from_buffers(pa.binary(), len(block), [valid(block), pa.py_buffer(at), got.buffers()[2]], block.null_count))
    return pa.concat_arrays(done) if done else pa.array([], pa.binary())


def valid(x: pa.Array) -> pa.Buffer | None:
    return pa.array(x.is_valid()).buffers()[1] if x.null_count else None


def blocks(x: pa.Array):
    """An Arrow column of texts or lists in slices of at most BLOCK bytes or ids; longer ones by themselves."""
    sizes = pc.fill_null(pc.binary_length(x) if pa.types.is_string(x.type) else pc.list_value_length(x), 0).to_numpy()
    total, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(x):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK, side="right")))
        yield x.slice(start, stop - start)
        start = stop


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The vocabulary of a file, once in each Python worker."""
    return Bpe(path)


def encode(text: Column, path: str | None = None) -> Column:
    """Ids (array<int>) of a text column."""
    path = path or default_path()

    def run(texts: pa.Array) -> pa.Array:
        return load(path).encode_array(texts)

    return F.arrow_udf(run, ArrayType(IntegerType()))(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an ids column (array<int>); null for null."""
    path = path or default_path()

    def run(lists: pa.Array) -> pa.Array:
        return load(path).decode_array(lists)

    return F.arrow_udf(run, StringType())(ids)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The table with a column ids."""
    return docs.withColumn(ids, encode(F.col(text), path))


def sha256(rows: pa.Array, less: int = 0) -> pa.Array:
    """SHA-256 of each row's bytes without so many at its end, in lower-case hexadecimal digits."""
    return pa.array([hashlib.sha256(memoryview(x.as_buffer())[: len(x.as_buffer()) - less]).hexdigest() for x in rows], pa.string())


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: texts are encoded, the ids decoded, and both
    digested block by block, so that neither leaves the worker."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = 0
            for block in blocks(batch["text"].cast(pa.string()).fill_null("")):
                ids = bpe.encode_texts(block)
                n = pc.list_value_length(ids)
                numbers, texts = sha256(bpe.decimals_of(ids), 1), sha256(bpe.decode_array(ids))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(block)), n.cast(pa.int64()), numbers, texts], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(block)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
