"""Byte-pair encoding and decoding with a public vocabulary, by forced boundaries.

A merge joins two neighbours to a token of the vocabulary, so no merge ever spans a pair of neighbouring bytes that stands in no
token. Such pairs are found once from the vocabulary, as a table of 256 x 256 flags, and a look at that table finds all certain cuts of
a block of texts at once: nearly every space, and the borders between letters, digits and marks. The fragments between cuts are
encoded independently and their ids concatenated; equal fragments, mostly words, are encoded once in a task.

What splits a text before merges, the byte-level pattern, looks at characters around a place in three cases only, and there a forced
pair is no cut, so that the pattern finds in each fragment what it finds there in the whole text: behind white space (a run
of white space leaves its last character to what follows it), in front of or soon behind an apostrophe (contractions), and
within a character. A file with another pattern, a normaliser, or options that change merges is refused, not encoded wrongly.

Within a fragment the pattern's pieces are merged by a heap of ranked pairs, in n log n steps for a piece of n bytes, so long
runs without a cut are no trap. The strings of added tokens are looked for first, the longest at the earliest place, as the tokenizers library does.

Decoding joins the tokens' bytes by one gather for a block of texts; bytes that are no UTF-8 become U+FFFD, as the library has it.

Defined results: null texts are empty, and have no ids; an id outside the vocabulary decodes to nothing; rows that repeat are
encoded each; a null doc_id is kept; texts of any length are read whole, one fragment at a time; an empty table gives no rows; of the
table only the columns of id and text are read, so others may have any names.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.bytes import pieces, utf8

#: Distinct fragments whose ids are remembered; beyond, the memory starts anew.
REMEMBERED = 150_000
#: Bytes of text, or of ids, that are worked on together.
PIECE = 2 << 20
#: Fragments that are merged side by side, and the bytes above which a piece is merged on its own.
BLOCK, LONG = 1 << 15, 64
#: The rank of a pair that isn't joined.
NEVER = np.iinfo(np.int64).max
#: The byte-level pattern, and the byte alphabet: printable Latin-1 characters stand for themselves, the other bytes, in
#: order, for the characters from 256 on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(_OTHERS)}


class Vocabulary:
    """Tokens, merges and forced boundaries of a tokenizer's file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        _refuse_others(spec)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(map(BYTE_OF.__getitem__, token)) for token, i in model["vocab"].items() if token not in self.added}
        self.id_of = {raw: i for i, raw in self.bytes_of.items()}
        self._merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self._ids = model["vocab"]
        self.single = [self.id_of.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("the vocabulary has no token for some byte")
        self.single_ids = np.array(self.single, np.int64)
        self.forced = self._forced()
        size = 1 + max([*self.bytes_of, *self.added.values()])
        every = self.bytes_of | {i: t.encode() for t, i in self.added.items()}
        self._flat = np.frombuffer(b"".join(every.get(i, b"") for i in range(size)), np.uint8)
        self._at = np.concatenate([[0], np.cumsum([len(every.get(i, b"")) for i in range(size)])])

    # What only encoding needs is made when it is first asked for; workers that decode have no use for it.

    @cached_property
    def merge(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and token of each pair of tokens that is joined."""
        return {(self._ids[a], self._ids[b]): (rank, self._ids[a + b]) for rank, (a, b) in enumerate(self._merges)}

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = sorted(((a << 32) | b, rank, joined) for (a, b), (rank, joined) in self.merge.items())
        return tuple(np.array([p[k] for p in pairs] or [-1], np.int64) for k in range(3))

    pair_keys = property(lambda self: self._pairs[0])
    pair_ranks = property(lambda self: self._pairs[1])
    pair_tokens = property(lambda self: self._pairs[2])

    @cached_property
    def ordered(self) -> bool:
        """Whether no token is made twice, and none before its parts."""
        made = {joined: rank for rank, joined in self.merge.values()}
        return len(made) == len(self.merge) and all(max(made.get(a, -1), made.get(b, -1)) < rank for (a, b), (rank, _) in self.merge.items())

    def _forced(self) -> np.ndarray:
        """forced[a, b]: byte b never follows byte a inside a token."""
        forced = np.ones((256, 256), bool)
        flat = np.frombuffer(b"".join(self.bytes_of.values()), np.uint8)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum([len(x) for x in self.bytes_of.values()]) - 1] = False  # last bytes of tokens
        at = np.flatnonzero(inside)
        forced[flat[at], flat[at + 1]] = False
        return forced

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids' tokens, and the new offsets of texts among them."""
        known = np.where(ids < len(self._at) - 1, ids, 0).astype(np.int64)
        size = np.where(ids < len(self._at) - 1, np.diff(self._at)[known], 0)
        total = np.concatenate([[0], np.cumsum(size)])
        return self._flat[np.repeat(self._at[known] - total[:-1], size) + np.arange(total[-1])], total[offsets]


def _refuse_others(spec: dict) -> None:
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and level and added and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")):
        raise ValueError("not a plain byte-level BPE file: its splitting, normalising or merging differs from what is done here")


class Encoder:
    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.known: dict[bytes, bytes] = {}
        self._pattern = regex.compile(PATTERN)
        special = sorted(self.vocabulary.added, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special)).encode()) if special else None

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the fragments: texts' starts, and forced boundaries."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            before, here = data[:-1], data[1:]
            sure = self.vocabulary.forced[before, here] & ~_SPACE[before] & (here != 39) & (before != 39) & ((here & 0xC0) != 0x80)
            # White space outside ASCII ends in a byte behind 0xC2, or two behind one of 0xE1 to 0xE3; other characters there are merely not cut behind.
            sure[1:] &= (data[:-2] != 0xC2) & (data[:-2] != 39)
            sure[2:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3)) & (data[:-3] != 39)
            cut[1:-1] = sure
        cut[offsets] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        raw = data.tobytes()
        if self._special is not None and self._special.search(raw):
            return [self._around_special(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        starts = self.cuts(data, offsets)
        out = self._fragments(raw, starts)
        first = np.searchsorted(starts, offsets).tolist()
        return [b"".join(out[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def _around_special(self, raw: bytes) -> bytes:
        """A text that may hold strings of added tokens."""
        out, at = [], 0
        plain = lambda x: self._fragments(x, self.cuts(np.frombuffer(x, np.uint8), np.array([0, len(x)])))
        for found in self._special.finditer(raw):
            out += [*plain(raw[at : found.start()]), struct.pack("<I", self.vocabulary.added[found.group().decode()])]
            at = found.end()
        return b"".join([*out, *plain(raw[at:])])

    def _fragments(self, raw: bytes, starts: np.ndarray) -> list[bytes]:
        """Ids of each fragment; those that weren't met before are merged side by side."""
        edges, known = [*starts.tolist(), len(raw)], self.known
        fragments = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(known) > REMEMBERED:
            known.clear()
        out = list(map(known.get, fragments))
        missing = [k for k, ids in enumerate(out) if ids is None]
        new = list({fragments[k] for k in missing})
        for at in range(0, len(new), BLOCK):
            some = new[at : at + BLOCK]
            split = [self._pattern.findall(f.decode("utf-8", "replace")) for f in some]
            ids, of_piece = self.merged([p.encode() for ps in split for p in ps])
            packed = ids.astype("<u4").tobytes()
            edge = (4 * of_piece[np.cumsum([0, *map(len, split)])]).tolist()
            known.update(zip(some, [packed[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], strict=True))
        for k in missing:
            out[k] = known[fragments[k]]
        return out

    def merged(self, pieces_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and their n+1 offsets. In a round every short piece joins all places of its own least-ranked pair, which is what joining
        them one by one comes to, as a pair with a token that is new has a higher rank; long pieces go through a heap."""
        v = self.vocabulary
        size = np.fromiter(map(len, pieces_), np.int64, len(pieces_))
        long = size > LONG if v.ordered else np.ones(len(size), bool)
        short = np.flatnonzero(~long)
        symbol = v.single_ids[np.frombuffer(b"".join([pieces_[i] for i in short.tolist()]), np.uint8)]
        owner = np.repeat(short, size[short])
        done_symbols, done_owners = [], []
        rank, joined = self._pairs(symbol, owner, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            many = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(rank, first)
            ended = np.repeat(least == NEVER, many)
            if ended.any():
                done_symbols.append(symbol[ended])
                done_owners.append(owner[ended])
                symbol, owner, rank, joined = (x[~ended] for x in (symbol, owner, rank, joined))
                least, many = least[least != NEVER], many[least != NEVER]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, many))
            # Of overlapping places, as in a run of one symbol, the first, third, ... are joined.
            run = np.cumsum(np.concatenate([[True], np.diff(hit) != 1])) - 1
            start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            hit = hit[(np.arange(len(hit)) - start[run]) % 2 == 0]
            symbol[hit] = joined[hit]
            left = np.ones(len(symbol), bool)
            left[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where the joined symbols are now
            symbol, owner, rank, joined = symbol[left], owner[left], rank[left], joined[left]
            changed = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[changed], joined[changed] = self._pairs(symbol, owner, changed)
        for i in np.flatnonzero(long).tolist():
            ids = self._heap_merged(pieces_[i])
            done_symbols.append(np.array(ids, np.int64))
            done_owners.append(np.full(len(ids), i))
        symbol, owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (done_symbols, done_owners))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.searchsorted(owner[order], np.arange(len(pieces_) + 1))

    def _pairs(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of the pairs of the symbols at these places and their next ones; NEVER where there is none."""
        v = self.vocabulary
        after = np.minimum(at + 1, max(0, len(symbol) - 1))
        key = (symbol[at] << 32) | symbol[after]
        place = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        there = (v.pair_keys[place] == key) & (after == at + 1) & (owner[at] == owner[after])
        return np.where(there, v.pair_ranks[place], NEVER), v.pair_tokens[place]

    def _heap_merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the neighbours of the least rank, the first of them, are joined until none can be."""
        merge, ids = self.vocabulary.merge, [self.vocabulary.single[b] for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*merge[p], k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merge]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            _, joined, k, pair = heapq.heappop(heap)
            n = after[k]
            if n >= end or (ids[k], ids[n]) != pair:
                continue
            ids[k], ids[n] = joined, -1
            after[k] = n = after[n]
            if n < end:
                before[n] = k
                if (p := (joined, ids[n])) in merge:
                    heapq.heappush(heap, (*merge[p], k, p))
            if (b := before[k]) >= 0 and (p := (ids[b], joined)) in merge:
                heapq.heappush(heap, (*merge[p], b, p))
        return [i for i in ids if i >= 0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit numbers) of every text."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for part in pieces(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.encode(*utf8(part.column("text"))), pa.binary())], ["doc_id", "ids"])
        own.known.clear()  # a worker outlives its task

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, text of every row of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(tokenizer_path).vocabulary
        for part in pieces(batches, "ids", PIECE):
            ids, offsets = utf8(part.column("ids"))
            raw, at = vocabulary.decode(np.frombuffer(ids.tobytes(), "<u4"), offsets // 4)
            whole, at = raw.tobytes(), at.tolist()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("text", T.StringType())]))
