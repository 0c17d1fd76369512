"""Near-duplicate classes by DartMinHash signatures and banded joins.

Signatures. Each shingle of a text is an element with a weight: 1, or with ``weighted`` how often it occurs. Darts fall on an element's plane of weight and rank as a
Poisson process that depends on the element alone: the plane is cut into cells at powers of two, and a cell's number of
darts, their places and their signature coordinates come from hashes. A text keeps, for each coordinate, the dart of least
rank among those below its elements' weights; two texts share a coordinate with a probability that is their weighted Jaccard
similarity. Only ranks below about k (ln k + 3) / total weight are looked at, and more where a coordinate stays empty, so
the cost is that of the elements plus k log k.

Classes. Texts with equal words are one node. Nodes that share a band are in a bucket. No bucket is ever expanded into all
its pairs: some members are hubs, which are compared with the others of the bucket by exact Jaccard similarity of their
shingles (with weights, the sum of the lesser counts over that of the larger ones); links join components; and a bucket is finished when it lies in one component, or all its members have been hubs.
The number of hubs grows by rounds, linked members first, so that a bucket of copies is finished after a round or two, and
one of unlike texts is gone through in full in the end. From the second round on a pair is compared in one place, the first
bucket that it shares. In all rounds a pair is compared only if its signatures agree in at least as many coordinates as a pair of
the threshold's similarity has but for a chance of 2e-5; from the second round on, when what is left is mostly like but not near,
a finer signature of 1024 coordinates, of the members that are left, is asked too, with the same chance. Banding itself misses
such a pair with a chance of 1e-4. No bucket is capped, and no pair dropped for its size.

Everything is joins and aggregates over narrow tables in the shared folder; texts are read twice and never collected.
Equal words are recognised by 64-bit hashes: among n distinct texts about n^2 / 2^65 pairs are taken for equal by chance.

Defined results: lower-casing is of A-Z; a text of fewer words than ``width`` is one shingle; null and empty texts are
equal texts and so one class; rows that repeat are in one class; a null doc_id is kept, and a class is named by its least
non-null doc_id; an empty table gives no rows; texts of any length are read whole;
other columns are carried along where rows are kept and not read elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bytes import TO_LOWER, hashes, mixed, pieces, shingles, spans, utf8
from gaugeline.llm.storage import SMALL_ROWS, Scratch, keep

WIDTH, SIMILARITY = 5, 0.8
#: 280 coordinates: a pair of similarity 0.8 shares none of the bands with a chance of 1e-4, one of 0.3 shares one with 1e-2.
BANDS, ROWS = 40, 7
#: Coordinates of the finer signatures, which members of buckets that a first round hasn't finished get.
FINE = 1024
#: Rows of a narrow table that go to one task at least: tables of keys and labels aren't dealt more finely than that, as each task has its own costs.
NARROW_ROWS = 100_000
#: Members of a bucket, and hubs of it, that are compared in one place, about: what a larger bucket has to compare is dealt by cells of so many of each.
CELL = 512
#: Darts and elements that are handled at once, about, as numpy needs about a hundred bytes for each; a single text's are always handled together.
DARTS = 1 << 19
#: Rank cells start at 2^-6 and double; an area above this is cut into equal slices.
FIRST_RANK, MOST_AREA = 1 / 64, 64.0
_UNIT = 1.0 / (1 << 53)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def _constant(*parts: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little"))


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts in a cell."""
    p, out, n = math.exp(-area), [], 0
    total = p
    while total < 1 - 1e-15 and n < 1000:
        out.append(total)
        n += 1
        p *= area / n
        total += p
    return np.array([*out, total])


def _cells(limit: float, first: float) -> Iterator[tuple[int, float, float]]:
    """(number, begin, end) of the cells that begin below ``limit``."""
    number, begin, end = 0, 0.0, first
    while begin < limit:
        yield number, begin, end
        number, begin, end = number + 1, end, 2 * end


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, offsets: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (texts x k, 64 bits) of weighted sets; elements of a text are distinct and stand at offsets[i]:offsets[i+1].
    weights: None for 1 each. Texts without elements get zeros. Texts go by runs of about DARTS elements and darts, as a text has some thousand darts however short it is."""
    n = len(offsets) - 1
    out = np.zeros((n, k), np.uint64)
    cost = np.cumsum(np.concatenate([[0], np.diff(offsets) + math.ceil(k * (math.log(k) + 3))]))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + DARTS, "right")) - 1)
        of_run = slice(offsets[at], offsets[end])
        out[at:end] = _thrown(elements[of_run], None if weights is None else weights[of_run], offsets[at : end + 1] - offsets[at], k, seed)
        at = end
    return out


def _thrown(elements: np.ndarray, weights: np.ndarray | None, offsets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Signatures of the texts of one run."""
    n = len(offsets) - 1
    out = np.zeros((n, k), np.uint64)
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    total = size.astype(np.float64) if weights is None else np.bincount(text, weights, n)
    rank_limit = np.where(total > 0, k * (math.log(k) + 3) / np.maximum(total, 1e-300), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        mine = np.flatnonzero(chosen[text])
        e, t = elements[mine], text[mine]
        w = None if weights is None else weights[mine]
        limit = rank_limit[t]
        best = np.full(n * k, np.inf)
        value = np.zeros(n * k, np.uint64)
        # Elements above each weight cell's start: ever fewer.
        weight_cells = [(*cell, None if w is None or not cell[0] else np.flatnonzero(w > cell[1])) for cell in _cells(1.0 if w is None else float(w.max()), 1.0)]
        for rank_cell, r0, r1 in _cells(float(limit.max()), FIRST_RANK):
            ranked = np.flatnonzero(limit > r0) if r0 >= float(limit.min()) else None
            for weight_cell, w0, w1, above in weight_cells:
                live = ranked if above is None else above[limit[above] > r0]
                if live is not None and not len(live):
                    continue
                ee, tt, ll = (e, t, limit) if live is None else (e[live], t[live], limit[live])
                ww = None if w is None else (w if live is None else w[live])
                slices = max(1, math.ceil((r1 - r0) * (w1 - w0) / MOST_AREA))
                steps = _poisson_steps((r1 - r0) * (w1 - w0) / slices)
                for piece in range(slices):
                    low = r0 + (r1 - r0) * piece / slices
                    high = r0 + (r1 - r0) * (piece + 1) / slices
                    h = mixed(ee ^ _constant(seed, rank_cell, weight_cell, piece))
                    u = _uniform(h)
                    some = np.flatnonzero(u >= steps[0])
                    if not len(some):
                        continue
                    many = np.searchsorted(steps, u[some], "right")
                    source = np.repeat(some, many)
                    ordinal = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
                    dart = mixed(h[source] + (ordinal.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                    rank = low + (high - low) * _uniform(dart)
                    other = mixed(dart ^ np.uint64(0xD6E8FEB86659FD93))
                    fits = rank < ll[source]
                    if ww is not None:
                        fits &= w0 + (w1 - w0) * _uniform(mixed(other + np.uint64(1))) < ww[source]
                    source, dart, rank, other = source[fits], dart[fits], rank[fits], other[fits]
                    slot = tt[source] * k + (other % np.uint64(k)).astype(np.int64)
                    np.minimum.at(best, slot, rank)
                    won = best[slot] == rank
                    value[slot[won]] = dart[won]
        done = np.isfinite(best.reshape(n, k)).all(axis=1) & chosen
        out[done] = value.reshape(n, k)[done]
        todo = np.flatnonzero(chosen & ~done)
        rank_limit[todo] *= 2
    return out


def distinct_elements(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text, in order, their counts, and the new offsets."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(text[at], np.arange(len(offsets)))


def occurrences(elements: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's elements once for each occurrence, the later ones under names of their own, and the new offsets: two texts' plain
    Jaccard similarity on these is the weighted one on elements and counts."""
    first = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    names = np.repeat(elements, counts)
    again = np.flatnonzero(nth)
    names[again] = mixed(names[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return names, first[offsets]


def _elements(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and words before each text, then distinct shingles, their counts and offsets."""
    data, offsets = utf8(column)
    data = TO_LOWER[data]
    starts, ends, before = spans(data, offsets)
    words = hashes(data, starts, ends)
    return (words, before, *distinct_elements(*shingles(words, before, width)))


def _nodes(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    raw = words.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)], np.int64)


def sketch(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, raw (hash of the text as it is), node (hash of its words), n (its shingles; without weights, distinct ones), bands, and sig: a
    byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            words, before, elements, counts, offsets = _elements(part.column("text"), width)
            signature = dart_signatures(elements, counts.astype(np.float64) if weighted else None, offsets, bands * rows)
            grouped = signature.reshape(len(offsets) - 1, bands, rows)
            key = np.zeros(grouped.shape[:2], np.uint64)
            for k in range(rows):
                key = mixed((key ^ grouped[:, :, k]) + np.uint64(k + 1))
            key = mixed(key + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            columns = [part.column("doc_id").cast(pa.int64()), part.column("raw"), pa.array(_nodes(words, before)), pa.array(np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets] if weighted else offsets), pa.int64()), lists(key), lists(signature.astype(np.uint8).view(np.int8))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "raw", "node", "n", "bands", "sig"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text")).mapInArrow(run, "doc_id long, raw long, node long, n long, bands array<long>, sig array<byte>")


def shingle_sets(docs: DataFrame, width: int = WIDTH, weighted: bool = False) -> DataFrame:
    """node, items (the low 32 bits of the hashes of the shingles' occurrences, or without weights of the shingles; chance agreement
    changes a similarity by far less than 1e-4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            words, before, elements, counts, offsets = _elements(part.column("text"), width)
            if weighted:
                elements, offsets = occurrences(elements, counts, offsets)
            items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(elements.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(words, before)), items], ["node", "items"])

    return docs.select("text").mapInArrow(run, "node long, items array<int>")


def fine_signatures(sets: DataFrame, k: int = FINE) -> DataFrame:
    """node, fine: a byte of each of ``k`` coordinates, drawn independently of sketch()'s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                items = part.column("items")
                offsets = items.offsets.to_numpy().astype(np.int64)
                elements = mixed(items.flatten().to_numpy().view(np.uint32).astype(np.uint64) + np.uint64(1))
                signature = dart_signatures(elements, None, offsets - offsets[0], k, seed=2).astype(np.uint8).view(np.int8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * k, pa.int32()), pa.array(signature.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "fine"])

    return sets.select("node", "items").mapInArrow(run, "node long, fine array<byte>")


# ------------------------------------------------------------------ components


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = keep, small: int = SMALL_ROWS) -> DataFrame:
    """node, comp (least node of its component) for all nodes of the edges (a, b).

    A graph of at most ``small`` edges, by a count of the written table, is one task's work of some MB. A larger one goes by alternating large and small
    stars: each half step is a map-side combined minimum and a join of two written tables, so that Spark can split a hub's rows. Edges that
    are stars already take no step.
    """
    edges = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    if edges.limit(small + 1).count() <= small:
        return edges.repartition(1).mapInArrow(_joined, "node long, comp long")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
        # Large star: larger neighbours of a node now point to its least neighbour (or itself).
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = keep(large.distinct(), "cc-large")
        # Small star: a node and its smaller neighbours point to the least of them.
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of all batches: every node takes the least label of its neighbours and then its label's, until none changes."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([*(a for a, _ in parts), *(b for _, b in parts)])
    nodes, place = np.unique(ends, return_inverse=True)
    x, y = place[: len(ends) // 2], place[len(ends) // 2 :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "comp"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or only edges to larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


# ------------------------------------------------------------------ buckets


def _compare(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose shingles are similar enough."""
    b_side = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("of_b")), "b")
    full = b_side.join(sets.select(F.col("node").alias("a"), F.col("items").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    # The tolerance keeps similarities of exactly the threshold, as 4/5, on the inside.
    return full.filter(common >= F.lit(similarity) * union - F.lit(1e-9)).select("a", "b")


def least_agreement(similarity: float, coordinates: int) -> int:
    """Equal signature coordinates that a pair of this similarity has but for a chance of 2e-5."""
    return max(0, math.floor(coordinates * similarity - 4.2 * math.sqrt(coordinates * similarity * (1 - similarity))))


def link_classes(sketches: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, coordinates: int = BANDS * ROWS, weighted: bool = False, gate: bool = True) -> DataFrame:
    """node, comp for the nodes that are linked to others. ``gate``: whether signatures may rule out a pair."""
    with Scratch(sketches.sparkSession) as scratch:
        found = _link_classes(sketches, docs, similarity, width, coordinates, weighted, gate, scratch.keep)
        return keep(found, "dup-classes")


def _link_classes(sketches: DataFrame, docs: DataFrame, similarity: float, width: int, coordinates: int, weighted: bool, gate: bool, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    spark = sketches.sparkSession
    parts = max(16, -(-sketches.count() // NARROW_ROWS))
    narrow = lambda df, name: keep(df.coalesce(parts), name)
    nodes = narrow(sketches.filter("n > 0").groupBy("node").agg(F.min_by(F.struct("n", "bands", "sig", "doc_id"), F.coalesce("doc_id", F.lit(1 << 62))).alias("s")).select("node", "s.n", "s.bands", "s.sig", "s.doc_id"), "dup-nodes")
    entries = nodes.select("node", F.col("n").alias("size"), F.explode("bands").alias("bucket"))
    shared = narrow(entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket"), "dup-buckets")
    members = narrow(entries.join(shared, "bucket").select("bucket", "node", "size", F.lit(False).alias("served")), "dup-members")
    wanted = narrow(members.select("node").distinct().join(nodes, "node").select("node", "doc_id", "bands", "sig"), "dup-wanted")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = shingle_sets(texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id), "left_semi"), width, weighted)
    sets = keep(sets.groupBy("node").agg(F.first("items").alias("items")), "dup-sets")
    labels = fine = None
    hubs = 1
    while True:
        state = members.withColumn("comp", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        linked = F.lit(False) if labels is None else F.col("in_class")
        if labels is not None:
            state = state.withColumn("in_class", F.coalesce("in_class", F.lit(False)))
        state = narrow(state.withColumn("linked", linked).select("bucket", "node", "size", "served", "comp", "linked").withColumn("draw", F.pmod(F.xxhash64("node", F.lit(hubs)), F.lit(1 << 52)) / F.lit(float(1 << 52))), "dup-state")
        open_ = ~F.col("served")
        stats = state.groupBy("bucket").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_if(open_).alias("open"),
            F.count_if(open_ & F.col("linked")).alias("open_linked"),
            F.min(F.when(open_, F.struct((~F.col("linked")).alias("l"), "node"))).alias("first"),
        )
        # With one member left that was no hub, it has been compared with all others.
        stats = narrow(stats.filter("low <> high and open > 1").select("bucket", "open", "open_linked", F.col("first.node").alias("first")), "dup-active")
        if stats.isEmpty():
            break
        active = state.join(stats, "bucket")
        share = F.lit(float(hubs)) / F.when(F.col("linked"), F.col("open_linked")).otherwise(F.col("open"))
        active = active.withColumn("hub", open_ & ((F.col("node") == F.col("first")) | (F.col("draw") < share))).select("bucket", "node", "size", "served", "comp", "hub", "open")
        # A pair is compared only if the signatures allow the similarity, as buckets hold many pairs that are like, but not near; and after
        # the first round, in which each bucket has one hub, in one place only, the first bucket that it shares.
        extra = ["sig"] if labels is None else ["sig", "bands"]
        active = active.join(wanted.select("node", *extra), "node")
        if labels is not None and gate:
            if fine is None:
                fine = keep(fine_signatures(sets.join(active.select("node").distinct(), "node", "left_semi")), "dup-fine")
            active, extra = active.join(fine, "node"), [*extra, "fine"]
        active = keep(active.select("bucket", "node", "size", "served", "comp", "hub", "open", *extra), "dup-round")
        agree = lambda c: F.size(F.filter(F.zip_with(f"{c}_a", f"{c}_b", lambda x, y: x == y), lambda x: x))
        near = (F.least("sa", "sb") >= F.lit(similarity) * F.greatest("sa", "sb") - F.lit(1e-9)) & F.expr("ca <> cb and (not hb or a < b)")
        if gate:
            near = near & (agree("sig") >= least_agreement(similarity, coordinates))
            if labels is not None:
                near = near & (agree("fine") >= least_agreement(similarity, FINE))
        if labels is not None:
            near = near & (F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("h.bucket"))
        # A bucket is a grid of cells, members by hubs; each member goes to the cells of its line, each hub to those of its column. Sides are dealt by cells and not
        # by Spark's splitting of large partitions, which makes a task of each piece of one side with each of the other.
        lines, columns = F.ceil(F.col("open") / CELL).cast("int"), F.ceil(F.least("open", F.lit(2 * hubs)) / CELL).cast("int")
        own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        h = active.filter("hub").select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("sa"), *[F.col(c).alias(f"{c}_a") for c in extra], every(lines).alias("line"), own(columns).alias("column"))
        m = active.filter("not served").select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("sb"), F.col("hub").alias("hb"), *[F.col(c).alias(f"{c}_b") for c in extra], own(lines).alias("line"), every(columns).alias("column"))
        cell = ("bucket", "line", "column")
        meet = reduce(Column.__and__, [F.col(f"m.{c}") == F.col(f"h.{c}") for c in cell])
        pairs = m.repartition(*cell).alias("m").join(h.repartition(*cell).alias("h"), meet & near).select("a", "b").distinct()
        links = keep(_compare(keep(pairs, "dup-pairs"), sets, similarity), "dup-links")
        edges = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        labels = narrow(components(edges, narrow).withColumn("in_class", F.lit(True)), "dup-labels")
        members = narrow(active.select("bucket", "node", "size", (F.col("served") | F.col("hub")).alias("served")), "dup-members")
        hubs *= 16
    return spark.createDataFrame([], "node long, comp long") if labels is None else labels.select("node", "comp")


def classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, gate: bool = True) -> DataFrame:
    """doc_id, raw, comp for every row of ``docs`` (doc_id, text): rows of equal comp are near duplicates, links carried on."""
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.keep(sketch(docs, width, bands, rows, weighted), "dup-sketch")
        labels = link_classes(sketches, docs, similarity, width, bands * rows, weighted, gate)
        return keep(sketches.select("doc_id", "raw", "node").join(labels, "node", "left").select("doc_id", "raw", F.coalesce("comp", "node").alias("comp")), "dup-rows")


def class_ids(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) for every row."""
    rows = classes(docs, **options)
    heads = keep(rows.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "dup-heads")
    return rows.join(heads, "comp").select("doc_id", "class_id")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the least doc_id, with all columns of ``docs``."""
    rows = classes(docs, **options)
    kept = keep(rows.groupBy("comp").agg(F.min_by(F.struct("doc_id", "raw"), F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "raw")).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.raw").alias("kept_raw")), "dup-kept")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"))
    found = marked.alias("d").join(kept.alias("k"), F.expr("d.id <=> k.kept_id and d.raw = k.kept_raw"), "left_semi")
    return found.dropDuplicates(["id", "raw"]).select("row.*")


