"""Benchmark decontamination: the n-grams of test items are seeds that find passages in training texts, and a Smith-Waterman
alignment of words scores each passage, so that edited copies count too.

The benchmark is the small side: it is taken in blocks of at most BLOCK_WORDS words, one after the other, so what is sent to the tasks
is bounded however large it grows; every block runs over all texts. Seeds are of two kinds. Every n-gram of an item is one, however
often it occurs: passages around them hold the plain copies. The others are close pairs, words at most two apart in the item and in the
text: an alignment that reaches the threshold has about as many of them as its score, so every text that is near an item, be each second word
changed or another word put behind each, has a passage with that many, and few other texts have. Two bounds no score can exceed sort
out passages that can't reach the threshold or a better hit than one that is known: the words that item and passage share, then the
score alone of the alignment, by halves of the word hashes in small integers. The others are aligned with their places. Texts are never
shuffled for it: a scan emits only hits, or drops the texts that have one.

Words are runs of bytes other than ASCII white space and punctuation, with A-Z lower-cased. An alignment gets 1 for an equal word,
-0.5 for an unequal one and for a gap; the score is its best local value over the item's number of words.

Defined results: null and empty texts and items never match; an item of fewer words than the n-grams matches only as the whole of a
text; items with equal ids or texts are each reported; rows that repeat are each judged; an empty benchmark or table
gives no rows; a null item id is reported as null; texts of any length are searched whole; columns other than ids and texts are
carried along where rows are kept and not read elsewhere, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bytes import IN_PLAIN_WORD, TO_LOWER, hashes, mixed, pieces, shingles, spans, utf8
from gaugeline.llm.storage import keep

WIDTH = 3
THRESHOLD = 0.4
#: Short items need this much too, or four fifths of themselves.
LEAST_SCORE = 6.0
BLOCK_WORDS = 1_000_000
#: Places where a seed occurs that are looked at together, whole texts at a time.
PLACES = 1 << 20
#: Cells of alignments that are scored at a time, which stay in the processor's caches.
CELLS = 1 << 16
EQUAL, UNEQUAL, GAP = 1.0, -0.5, -0.5
#: How far apart the words of a close pair are, in the item and in the text.
DISTANCES = (1, 2)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and words before each text."""
    data, offsets = utf8(column)
    data = TO_LOWER[data]
    starts, ends, before = spans(data, offsets, IN_PLAIN_WORD)
    return hashes(data, starts, ends), before


def alignments(items: list[np.ndarray], passages: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """Best local alignment of each pair: score, and first and last word of the passage (exclusive).

    Pairs are aligned side by side, a row of all matrices at a time; within a row, gaps in the passage are a running maximum.
    """
    out: list[tuple[float, int, int]] = [(0.0, 0, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda k: len(passages[k]))
    at = 0
    while at < len(order):
        # Pairs of like length, about a million cells a row at most.
        most = max(1, 1_000_000 // max(1, len(passages[order[min(at + 4095, len(order) - 1)]])))
        some = order[at : at + min(most, 4096)]
        at += len(some)
        wide, high = max(len(passages[k]) for k in some), max(len(items[k]) for k in some)
        if not wide or not high:
            continue
        p = np.zeros((len(some), wide), np.uint64)
        q = np.ones((high, len(some)), np.uint64)
        for r, k in enumerate(some):
            p[r, : len(passages[k])] = passages[k] | np.uint64(2)
            q[: len(items[k]), r] = items[k] | np.uint64(2)
        slope = -GAP * np.arange(wide + 1)
        row = np.zeros((len(some), wide + 1))
        begin = np.broadcast_to(np.arange(wide + 1), row.shape).copy()
        best, first, last = np.zeros(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        lines = np.arange(len(some))
        columns = np.arange(wide + 1)
        for i in range(high):
            cross = row[:, :-1] + np.where(p == q[i][:, None], EQUAL, UNEQUAL)
            down = row[:, 1:] + GAP
            value = np.maximum(cross, down)
            source = np.where(cross >= down, begin[:, :-1], begin[:, 1:])
            new = np.zeros_like(row)
            start = np.broadcast_to(columns, row.shape).copy()
            better = value > 0
            new[:, 1:][better] = value[better]
            start[:, 1:][better] = source[better]
            # A gap in the passage: the best earlier value less the way to it.
            lifted = new + slope
            run = np.maximum.accumulate(lifted, axis=1)
            from_ = np.maximum.accumulate(np.where(lifted == run, columns, 0), axis=1)
            gapped = run - slope
            use = gapped > new + 1e-12
            start = np.where(use, np.take_along_axis(start, from_, axis=1), start)
            row, begin = np.maximum(new, gapped), start
            top = row.argmax(axis=1)
            higher = row[lines, top] > best
            best = np.where(higher, row[lines, top], best)
            first = np.where(higher, begin[lines, top], first)
            last = np.where(higher, top, last)
        for r, k in enumerate(some):
            out[k] = (float(best[r]), int(first[r]), int(last[r]))
    return out


@dataclass
class Matcher:
    """The items of a block as word hashes, their seeds, sorted (hash, item, offset in the item), and their close pairs of words, sorted (hash, item)."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    width: int = WIDTH
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(ids: list[int | None], texts: list[str | None], width: int = WIDTH) -> Matcher:
        hashed, before = words_of(pa.array(texts, pa.string()))
        grams, offsets = shingles(hashed, before, width)
        item = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(grams, kind="stable")
        at = np.arange(len(grams)) - offsets[:-1][item] if len(ids) else np.zeros(0, np.int64)
        # Items of fewer words than the n-grams match as the whole of a text only.
        whole = np.repeat(np.diff(before) >= width, np.diff(before))
        some = np.concatenate([[0], np.cumsum(np.where(np.diff(before) >= width, np.diff(before), 0))])
        near, of_word = [], np.repeat(np.arange(len(ids)), np.diff(some))
        for d, both in _close_pairs(hashed[whole]):
            inside = np.flatnonzero(of_word[: len(both)] == of_word[d:])
            near.append((both[inside], of_word[inside]))
        pairs = np.unique(np.array([*zip(np.concatenate([h for h, _ in near]).tolist(), np.concatenate([i for _, i in near]).tolist(), strict=True)], [("h", "<u8"), ("i", "<i8")]))
        return Matcher(ids, [hashed[a:b] for a, b in zip(before[:-1], before[1:], strict=True)], grams[order], item[order], at[order], width, pairs["h"].copy(), pairs["i"].copy())

    def _sieve(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        size = 1 << max(10, int(16 * len(keys)).bit_length())
        if (bits := self.__dict__.get(name)) is None:
            bits = self.__dict__[name] = np.zeros(size, bool)
            bits[(keys & np.uint64(size - 1)).astype(np.int64)] = True
        return bits, np.uint64(size - 1)

    def occurrences(self, grams: np.ndarray, name: str = "seeds") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the n-grams that are seeds (or close pairs: "pairs"), and the range of those each one is: first and last (exclusive)."""
        keys = getattr(self, name)
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits, mask = self._sieve(f"_bits_of_{name}", keys)
        maybe = np.flatnonzero(bits[(grams & mask).astype(np.int64)])
        low = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
        true = np.flatnonzero(keys[low] == grams[maybe])
        if (ends := self.__dict__.get(f"_ends_of_{name}")) is None:
            ends = self.__dict__[f"_ends_of_{name}"] = np.searchsorted(keys, keys, "right")
        return maybe[true], low[true], ends[low[true]]

    def _lengths(self) -> np.ndarray:
        """Words of each item."""
        if getattr(self, "_long", None) is None:
            self._long = np.array([len(w) for w in self.words], np.int64)
        return self._long

    def _item_words(self) -> np.ndarray:
        """The words of each item as hashes that tell items apart, sorted."""
        if getattr(self, "_known", None) is None:
            item = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
            self._known = np.unique(_of_item(np.concatenate([np.zeros(0, np.uint64), *self.words]), item))
        return self._known

    def bounds(self, hashed: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each passage, hashed[first:end], a score that its alignment with the item can't exceed.

        In an alignment a word of the passage that the item lacks costs UNEQUAL or GAP, and any other gives EQUAL at most.
        """
        out = np.zeros(len(item))
        known = self._item_words()
        if not len(known):
            return out
        size = end - first
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            # Passages of like length, about a million words at most.
            some = order[at : at + max(1, PLACES // max(1, int(size[order[min(at + 4095, len(order) - 1)]])))][:4096]
            at += len(some)
            columns = np.arange(int(size[some].max()))
            inside = columns < size[some][:, None]
            word = hashed[np.where(inside, first[some][:, None] + columns, 0)]
            key = _of_item(word, item[some][:, None])
            has = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            value = np.where(inside, np.where(has, EQUAL, max(UNEQUAL, GAP)), 0.0)
            sums = np.concatenate([np.zeros((len(some), 1)), np.cumsum(value, axis=1)], axis=1)
            out[some] = (sums - np.minimum.accumulate(sums, axis=1)).max(axis=1)
        return out

    def scores(self, hashed: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The score of each passage's alignment with the item, if words with equal lower halves of their hashes were equal: never less than that of alignments().

        Cells are doubled scores in the smallest integers that hold them, a diagonal of some pairs' matrices at a time: each needs the two diagonals before it only.
        """
        out = np.zeros(len(item))
        length, size = self._lengths()[item], end - first
        begin = np.concatenate([[0], np.cumsum(self._lengths())])[item]
        own = np.concatenate([np.zeros(0, np.uint64), *self.words])
        order = np.lexsort((size, length))
        equal, cost = int(2 * (EQUAL - UNEQUAL)), int(-2 * UNEQUAL)  # a gap costs the same
        at = 0
        while at < len(order):
            # Items and passages of like length.
            high = max(1, int(length[order[min(at + 255, len(order) - 1)]]))
            some = order[at : at + max(1, min(CELLS // high, 256, PLACES // max(1, int(size[order[at : at + 256]].max()))))]
            at += len(some)
            high, wide = int(length[some].max()), int(size[some].max())
            if not high or not wide:
                continue
            kind = np.int8 if 2 * high + equal < 1 << 7 else np.int16 if 2 * high + equal < 1 << 15 else np.int32
            rows, columns = np.arange(high)[:, None], np.arange(wide)[::-1, None]
            q = np.ones((high, len(some)), np.uint32)
            np.copyto(q, own[np.minimum(begin[some] + rows, len(own) - 1)].astype(np.uint32) | np.uint32(2), where=rows < length[some])
            # The passages backwards, so that a diagonal meets words that follow each other.
            p = np.zeros((wide + 2 * high - 2, len(some)), np.uint32)
            np.copyto(p[high - 1 : high - 1 + wide], hashed[np.minimum(first[some] + columns, len(hashed) - 1)].astype(np.uint32) | np.uint32(2), where=columns < size[some])
            one, two, new = (np.zeros((high + 1, len(some)), kind) for _ in range(3))
            same, best = np.zeros(q.shape, bool), np.zeros(q.shape, kind)
            for k in range(wide + high - 2, -1, -1):
                cell = new[1:]
                np.equal(q, p[k : k + high], out=same)
                np.multiply(same.view(np.int8), kind(equal), out=cell, dtype=kind)
                cell += two[:-1]
                np.maximum(cell, one[:-1], out=cell)
                np.maximum(cell, one[1:], out=cell)
                cell -= kind(cost)
                np.maximum(cell, kind(0), out=cell)
                np.maximum(best, cell, out=best)
                one, two, new = new, one, two
            out[some] = best.max(axis=0) / 2
        return out

    def hits(self, column: pa.Array, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, end word) for each text and item with an alignment that reaches the threshold; the best each."""
        hashed, before = words_of(column)
        grams, offsets = shingles(hashed, before, self.width)
        where, low, high = self.occurrences(grams)
        text = np.searchsorted(offsets, where, "right") - 1
        # Whole texts, with PLACES places or one text at a time.
        done = np.concatenate([[0], np.cumsum(high - low)])
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        at = 0
        while at < len(where):
            end = max(at + 1, int(np.searchsorted(done, done[at] + PLACES, "right")) - 1)
            end = int(np.searchsorted(text, text[end - 1], "left")) if end < len(where) and text[end] == text[end - 1] else end
            end = end if end > at else int(np.searchsorted(text, text[at], "right"))
            self._add(found, hashed, before, self._of_seeds(where[at:end] - offsets[text[at:end]], text[at:end], low[at:end], high[at:end], before), threshold)
            at = end
        for passages in self._of_pairs(hashed, before, threshold):
            self._add(found, hashed, before, passages, threshold)
        return [(t, i, *rest) for (t, i), rest in sorted(found.items())]

    def _needed(self, item: np.ndarray, threshold: float) -> np.ndarray:
        """The least score of a hit."""
        length = self._lengths()[item]
        return np.maximum(threshold * length, np.minimum(LEAST_SCORE, 0.8 * length))

    def _of_pairs(self, hashed: np.ndarray, before: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Passages (text, item, first, end) that hold enough close pairs of an item near each other.

        Between two equal words that follow each other in an alignment stand at most one unequal word or gap, and they are a close pair, or more, which
        cost as much as the second word gives. So an alignment has its score less 1 of close pairs at least, and no more
        words of the text than the item's and twice what the item's words may give beyond the score: no hit is without such a passage.
        """
        near = []
        for d, both in _close_pairs(hashed):
            where, low, high = self.occurrences(both, "pairs")
            inside = np.flatnonzero(where + d < before[np.searchsorted(before, where, "right")])
            near.append((where[inside], low[inside], high[inside]))
        place, low, high = (np.concatenate([x[k] for x in near]) for k in range(3))
        order = np.argsort(place, kind="stable")
        place, low, high = place[order], low[order], high[order]
        text = np.repeat(np.arange(len(before) - 1), np.diff(np.searchsorted(place, before)))
        done, at = np.concatenate([[0], np.cumsum(high - low)]), 0
        while at < len(place):
            # Whole texts, with PLACES places or one text at a time.
            end = int(np.searchsorted(text, text[max(at, min(int(np.searchsorted(done, done[at] + PLACES, "right")), len(text)) - 1)], "left"))
            end = end if end > at else int(np.searchsorted(text, text[at], "right"))
            many = (high - low)[at:end]
            pair = np.repeat(low[at:end] - (done[at:end] - done[at]), many) + np.arange(done[end] - done[at])
            yield self._crowded(self.pair_item[pair], np.repeat(place[at:end], many), before, threshold)
            at = end

    def _crowded(self, item: np.ndarray, place: np.ndarray, before: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
        """The passages of items and the places, in all words, of their close pairs. They are sorted as one number, item and place."""
        bits = int(before[-1]).bit_length()
        key = np.sort((item << bits) | place)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]  # a word that begins several pairs counts once
        length = self._lengths()
        needed = self._needed(np.arange(len(length)), threshold)
        spans = length + np.ceil(2 * np.maximum(0.0, length - needed)).astype(np.int64) + 1
        least = np.maximum(1, np.ceil(needed - 1 - 1e-6)).astype(np.int64)
        item = key >> bits
        last = np.arange(len(key)) + least[item] - 1
        # An item's last places and the next one's first can look near each other: that is seen below.
        there = np.flatnonzero(key[np.minimum(last, len(key) - 1)] - key <= spans[item])
        there = there[last[there] < len(key)]
        z = key[last[there]]
        there, z = there[z >> bits == item[there]], z[z >> bits == item[there]]
        item, a, z = item[there], key[there] & ((1 << bits) - 1), z & ((1 << bits) - 1)
        text = np.searchsorted(before, a, "right") - 1
        same = np.flatnonzero(z < before[text + 1])
        text, item = text[same], item[same]
        a, z, span, length = a[same] - before[text], z[same] - before[text], spans[item], length[item]
        # Windows that begin near each other are one passage, which so is a few times the item's size at most.
        part = a // (2 * length + 1)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])
        runs = np.flatnonzero(new)
        if not len(runs):
            return text, item, a, z
        end = np.minimum(np.diff(before)[text[runs]], a[np.append(runs[1:], len(text)) - 1] + span[runs])
        first = np.maximum(0, np.minimum.reduceat(z, runs) - span[runs])
        return text[runs], item[runs], np.minimum(first, a[runs]), end

    def _of_seeds(self, position: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Passages (text, item, first, end) around seeds of some whole texts; low to high (exclusive) are the seeds at each position."""
        many = high - low
        seed = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        position, text = np.repeat(position, many), np.repeat(text, many)
        item, begin = self.seed_item[seed], position - self.seed_at[seed]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        length = self._lengths()[item]
        # Seeds of one copy say nearly the same place of the item's start; further away another copy begins.
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > length[1:] // 2 + 3)
        runs = np.flatnonzero(new)
        last = np.append(runs[1:], len(text)) - 1
        text, item, length = text[runs], item[runs], length[runs]
        pad = length // 4 + 3
        return text, item, np.maximum(0, begin[runs] - pad), np.minimum(np.diff(before)[text], begin[last] + length + pad)

    def _add(self, found: dict[tuple[int, int], tuple[float, int, int]], hashed: np.ndarray, before: np.ndarray, passages: tuple[np.ndarray, ...], threshold: float) -> None:
        """Align the passages that can reach the threshold and are not known to be no better, and keep the best hit of each text and item."""
        text, item, first, end = passages
        able = np.arange(len(text))
        for bound in (self.bounds, self.scores):
            most = bound(hashed, item[able], before[text[able]] + first[able], before[text[able]] + end[able])
            enough = np.flatnonzero(most >= self._needed(item[able], threshold) - 1e-6)
            able, most = able[enough], most[enough]
        known = [found.get(k, (0.0,))[0] for k in zip(text[able].tolist(), item[able].tolist(), strict=True)]
        able = able[most / np.maximum(1, self._lengths()[item[able]]) > np.array(known)]
        rows = list(zip(text[able].tolist(), item[able].tolist(), first[able].tolist(), end[able].tolist(), strict=True))
        scored = alignments([self.words[i] for _, i, _, _ in rows], [hashed[before[t] + a : before[t] + z] for t, _, a, z in rows])
        for (t, i, a, _), (value, begins, ends) in zip(rows, scored, strict=True):
            score = value / max(1, len(self.words[i]))
            enough = min(LEAST_SCORE, 0.8 * len(self.words[i]))
            if score >= threshold - 1e-9 and value >= enough - 1e-9 and score > found.get((t, i), (0.0,))[0]:
                found[t, i] = (score, a + begins, a + ends)


def _close_pairs(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distance, and the hashes of all pairs of words so far from each other, whether or not they stand in one text."""
    first = words | np.uint64(2)  # like an alignment, without telling apart words by the second bit
    second = mixed(first + np.uint64(0x9E3779B97F4A7C15))
    for d in DISTANCES:
        yield d, mixed(first[: max(0, len(words) - d)] ^ second[d:])


def _of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hashes of words that differ from item to item; like an alignment, without telling apart words by the second bit."""
    return mixed((words | np.uint64(2)) ^ mixed(item.astype(np.uint64) + np.uint64(1)))


# ------------------------------------------------------------------ distributed


def block_count(benchmark: DataFrame, text_col: str = "text") -> int:
    """Blocks of about BLOCK_WORDS words."""
    total = benchmark.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // (6 * BLOCK_WORDS)))


def matchers(benchmark: DataFrame, n: int, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> Iterator[Matcher]:
    """Matchers of the benchmark's blocks, one after the other: items are dealt by a hash of id and text, so that equal texts don't meet in one block."""
    for k in range(n):
        of_block = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k)
        rows = of_block.select(id_col, text_col).orderBy(id_col, text_col).collect()
        yield Matcher.of([r[0] for r in rows], [r[1] for r in rows], width)


def _hit_rows(docs: DataFrame, matcher: Matcher, threshold: float) -> DataFrame:
    """key, item_id, score, begin, end of the hits in rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = matcher.hits(part.column("text"), threshold)
            keys = part.column("key").take(pa.array([t for t, *_ in found], pa.int64()))
            columns = [keys, pa.array([matcher.ids[i] for _, i, *_ in found], pa.int64()), pa.array([x for _, _, x, _, _ in found], pa.float64()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "item_id", "score", "begin", "end"])

    return docs.mapInArrow(run, f"key {dict(docs.dtypes)['key']}, item_id long, score double, begin long, end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, begin, end (words of the text): the benchmark items that texts contain, edited or not.

    With several blocks each one's hits are written before the next is made, so driver and tasks hold one block at a time.
    """
    n, out = block_count(benchmark), None
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    for matcher in matchers(benchmark, n, width):
        found = _hit_rows(rows, matcher, threshold)
        found = found if n == 1 else keep(found, "leak-hits")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text contains no benchmark item. With one block no text is shuffled, as each is judged where it is read; with several the texts with hits
    are written block by block, as digests, and rows of these texts left out."""
    n = block_count(benchmark)
    if n > 1:
        digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        rows, leaks = docs.select(digest.alias("key"), F.col(text_col).alias("text")), None
        for matcher in matchers(benchmark, n, width):
            found = keep(_hit_rows(rows, matcher, threshold).select("key").distinct(), "leaks")
            leaks = found if leaks is None else leaks.unionByName(found)
        return docs.join(leaks.select(F.col("key").alias("__leak")).distinct(), digest == F.col("__leak"), "left_anti")
    # Columns go through under names of their own, as those of the table may hold dots.
    names = [f"c{k}" for k in range(len(docs.columns))]
    out, text = docs.toDF(*names), names[docs.columns.index(text_col)]
    matcher = next(matchers(benchmark, n, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            clean = np.ones(part.num_rows, bool)
            clean[[t for t, *_ in matcher.hits(part.column(text), threshold)]] = False
            yield part.filter(pa.array(clean))

    return out.mapInArrow(run, out.schema).toDF(*docs.columns)
