"""Language-model scores by logistic context mixing, beside a unigram base score.

The model predicts the bytes of a text (A-Z lower-cased) bit by bit, and a zero byte at its end. Each of five predictors knows how
often a bit was 0 and 1 in the training texts after its context, the last 0 to 4 bytes and the bits of the byte so far. Their
stretched probabilities are mixed by weights that a gate selects (how many contexts are known, and the bit's place); an adaptive
probability map, indexed by the bits so far, refines the result. Scores are sums of log10 probabilities.

What a byte's prediction depends on is the five-byte run it ends. So the corpus is gathered once, as counts of such runs over all
texts, and everything else is work on distinct runs:

* Contexts. Runs are dealt to tasks by a hash of their last three context bytes and sorted, so all runs of a context of three or
  four bytes are neighbours in one task; a group has 65,536 runs at most, whatever the corpus. Shorter contexts have 2^24 cells
  at most, and a task reads them as a table. So counts are by exact context, and no two contexts share one.
* Learning. Weights are learnt online: the training runs are dealt by a hash to PORTIONS portions, and the model takes a step
  after each. A step is an online Newton step for the coding cost of all occurrences in the portion, each with itself left out of
  the counts that predict it; gradients and curvatures are sums over tasks. Then one pass sets the probability map.
* Costs. Each distinct run gets its cost once, in units of UNIT. A text's score is the sum over its runs: frequent ones, HEAVY_RUNS
  at most, are looked up in place, all rarer ones go through a join on the run, in which no key can be hot. The same is done for words.

The order of learning is that of hashes, and sums are of whole units or rounded, so scores don't depend on how rows are dealt to
tasks. A text isn't learnt from while it is scored: equal texts get equal scores.

Defined results: null texts are empty; an empty text is its end token alone; repeated rows are scored each, and each counts in
training; without any training text all counts are 0, N and V are 0, and every bit has probability one half; zero bytes in a
text read like its end; a text of any length is taken in portions; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bytes import TO_LOWER, hashes, mixed, pieces, spans, stretches, utf8
from gaugeline.llm.storage import Scratch, keep, open_fs

ORDERS = 5
#: Bytes of text, and places of runs, that are looked at together.
PIECE = 1 << 20
#: Distinct keys that a task gathers before it passes them on.
TALLY = 1 << 19
#: Runs whose contexts are counted together, about; whole groups of three-byte contexts.
GROUPED = 1 << 16
#: Runs whose bits are looked at together.
SLICE = 1 << 13
#: The most runs and words that are looked up in place.
HEAVY_RUNS, HEAVY_WORDS = 1 << 20, 500_000
#: Steps of online learning.
PORTIONS = 8
#: Costs are whole numbers of this part of a factor of ten, so that their sums are exact.
UNIT = 1 / (1 << 20)
PRIOR = 0.4
GATES = ORDERS * 8
#: Steps of the probability map from -8 to 8.
STEPS = 33
WORD, RUN = 0, 1
N_INPUTS = ORDERS + 1
PAIRS = [(i, j) for i in range(N_INPUTS) for j in range(i, N_INPUTS)]


def training(doc_id: Column, parts: int = 7, out: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) != out


# ------------------------------------------------------------------ runs


@dataclass(frozen=True)
class Places:
    """Texts in a row with ORDERS - 1 zeros before and ORDERS zeros after each; a run ends at each byte of a text and at the zero after it."""

    flat: np.ndarray
    begins: np.ndarray  # where each text begins
    ends: np.ndarray  # where its end zero stands

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Places:
        n = len(offsets) - 1
        flat = np.zeros(len(data) + n * ORDERS + ORDERS - 1, np.uint8)
        begins = offsets[:-1] + np.arange(n) * ORDERS + ORDERS - 1
        for i in range(n):
            flat[begins[i] : begins[i] + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
        return Places(flat, begins, begins + np.diff(offsets))

    def slices(self, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes of runs as integers of five bytes, and the text of each, about ``most`` at a time; a text may go over several slices."""
        for low in range(0, len(self.flat) - ORDERS + 1, most):
            high = min(low + most, len(self.flat) - ORDERS + 1)
            codes = np.zeros(high - low, np.int64)
            for k in range(ORDERS):
                codes <<= 8
                codes |= self.flat[low + k : high + k]
            # The run that starts at place p ends at p + ORDERS - 1.
            first, last = np.searchsorted(self.ends, low + ORDERS - 1), np.searchsorted(self.begins, high + ORDERS - 1)
            begin = np.maximum(self.begins[first:last] - ORDERS + 1, low) - low
            end = np.minimum(self.ends[first:last] - ORDERS + 2, high) - low
            size = np.maximum(0, end - begin)
            text = np.repeat(np.arange(first, last), size)
            inside = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(text))
            yield codes[inside], text


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of some texts, and the n+1 offsets of texts among them."""
    found = list(Places.of(data, offsets).slices())
    codes = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in found)])
    return codes, np.concatenate([[0], np.cumsum(np.diff(offsets) + 1)])


class Tally:
    """Sums by key, of a bounded number of keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *sums: np.ndarray) -> None:
        self.parts.append((keys, *sums))
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, ...]:
        """The sums, each key once; they stay here."""
        if len(self.parts) > 1:
            keys, *sums = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.parts = [(keys[first], *(np.add.reduceat(s[order], first) for s in sums))]
            self.size = len(first)
        return self.parts[0] if self.parts else ()


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    return TO_LOWER[data], offsets


def gather(docs: DataFrame) -> DataFrame:
    """kind, key, n, seen: how often each word (kind WORD, training texts only) and five-byte run (RUN, all texts) occurs in training texts
    and in all. ``docs``: text, training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {WORD: Tally(), RUN: Tally()}

        def rows(kind: int) -> Iterator[pa.RecordBatch]:
            found = tallies[kind].merged()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), kind, np.int8)), *(pa.array(x, pa.int64()) for x in found)], ["kind", "key", "n", "seen"])
            tallies[kind] = Tally()

        for piece in pieces(batches, "text", PIECE):
            for learnt in (True, False):
                part = piece.filter(piece.column("training") if learnt else pa.compute.invert(piece.column("training")))
                data, offsets = _lower(part.column("text"))
                for codes, _ in Places.of(data, offsets).slices():
                    keys, n = _counted(codes)
                    tallies[RUN].add(keys, n * learnt, n)
                if learnt:
                    for some, at in stretches(data, offsets, PIECE):
                        starts, ends, _ = spans(some, at)
                        keys, n = _counted(hashes(some, starts, ends).view(np.int64))
                        tallies[WORD].add(keys, n, n)
            for kind, tally in tallies.items():
                # Merging halves what is held, or else it is passed on.
                if tally.size > TALLY and len(tally.merged()[0]) > TALLY // 2:
                    yield from rows(kind)
        for kind in tallies:
            yield from rows(kind)

    return docs.select("text", "training").mapInArrow(run, "kind byte, key long, n long, seen long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


# ------------------------------------------------------------------ contexts


class Counts:
    """Counts of runs of a width as sorted keys, with sums up to each."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Keys are sorted, and may repeat."""
        self.keys, self.sums = keys, np.concatenate([[0.0], np.cumsum(n, dtype=np.float64)])

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often 0 and 1 came at each bit of the last byte of each key (keys x 8), after its other bytes and the bits before."""
        out = np.empty((2, len(keys), 8))
        for j in range(8):
            low = keys >> 8 - j << 8 - j
            at = [self.sums[np.searchsorted(self.keys, x)] for x in (low, low + (1 << 7 - j), low + (1 << 8 - j))]
            out[0, :, j], out[1, :, j] = at[1] - at[0], at[2] - at[1]
        return out[0], out[1]


def short_counts(folder: str) -> list[Counts]:
    """Counts for contexts of 0, 1 and 2 bytes, from a table of three-byte runs, which has 2^24 rows at most."""
    fs, path = open_fs(folder)
    found = pads.dataset(path, schema=pa.schema([("key", pa.int64()), ("n", pa.int64())]), filesystem=fs, format="parquet").to_table()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    out = []
    for k in range(3):
        mine = keys & (1 << 8 * (k + 1)) - 1
        order = np.argsort(mine, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(mine[order]) > 0)) if len(keys) else np.zeros(0, np.int64)
        out.append(Counts(mine[order][first], np.add.reduceat(n[order], first) if len(keys) else n))
    return out


def context_counts(codes: np.ndarray, n: np.ndarray, short: list[Counts]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 of the contexts of each bit (runs x orders x 8). The runs are all there are of their contexts of three bytes."""
    out = np.empty((2, len(codes), ORDERS, 8))
    for k in range(ORDERS):
        keys = codes & (1 << 8 * (k + 1)) - 1
        distinct, which = np.unique(keys, return_inverse=True)
        table = short[k] if k < 3 else Counts(distinct, np.bincount(which, n, len(distinct)))
        for value, counts in enumerate(table.of(distinct)):
            out[value, :, k] = counts[which]
    return out[0], out[1]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key, n and seen of sorted rows, in portions of whole groups of three-byte contexts."""
    held, size = [], 0

    def portions(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal held, size
        key, n, seen = (np.concatenate(c) for c in zip(*held, strict=True))
        context = key >> 8 & 0xFFFFFF
        end = len(key) if last else int(np.flatnonzero(context != context[-1])[-1]) + 1 if context[0] != context[-1] else 0
        held, size = [(key[end:], n[end:], seen[end:])], len(key) - end
        if end:
            yield key[:end], n[:end], seen[:end]

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("key", "n", "seen")))
        size += batch.num_rows
        if size >= GROUPED:
            yield from portions(False)
    if size:
        yield from portions(True)


def by_context(found: DataFrame) -> DataFrame:
    """The runs dealt and sorted as grouped() needs them."""
    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF).cast("long")).cast("int").alias("context")
    return found.select(context, "key", "n", "seen").repartition("context").sortWithinPartitions("context", "key").select("key", "n", "seen")


# ------------------------------------------------------------------ mixing


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probabilities of the predictors (runs x orders x 8), and the weight set of each bit (runs x 8)."""
    known = (n0 + n1 >= 2)[:, 1:].sum(axis=1)
    return np.log((n1 + PRIOR) / (n0 + PRIOR)), known * 8 + np.arange(8)


def bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the last byte of each run (runs x 8), and the bits so far, from 1."""
    byte, place = (codes & 255)[:, None], np.arange(8)
    return byte >> (7 - place) & 1, 1 << place | byte >> (8 - place)


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.full((len(x), 1, 8), 0.3)], axis=1)


@dataclass(frozen=True)
class Mixer:
    weights: np.ndarray  # gates x inputs
    refined: np.ndarray | None = None  # 256 x STEPS probabilities

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Stretched probability of a 1 (runs x 8)."""
        return np.clip(np.einsum("nkb,nbk->nb", _with_constant(x), self.weights[gate]), -12, 12)

    def probability(self, x: np.ndarray, gate: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        z = self.mix(x, gate)
        p = squash(z)
        if self.refined is not None:
            low, part = _step(z)
            p = 0.5 * p + 0.5 * ((1 - part) * self.refined[so_far, low] + part * self.refined[so_far, low + 1])
        return np.clip(p, 1e-7, 1 - 1e-7)

    def costs(self, codes: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """Of the last byte of each run, in units."""
        bit, so_far = bits(codes)
        p = self.probability(*inputs(n0, n1), so_far)
        return np.rint(-np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=1) / UNIT).astype(np.int64)


def _step(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step of the probability map below a stretched probability, and how far it is on the way to the next."""
    x = (np.clip(z, -7.999, 7.999) + 8) * (STEPS - 1) / 16
    low = x.astype(np.int64)
    return low, x - low


class OnlineNewton:
    """Weights for each gate, and the curvature of all that was seen; ``step`` takes the sums of a portion."""

    def __init__(self, ridge: float = 1.0) -> None:
        self.weights = np.tile(np.append(np.full(ORDERS, 0.3), 0.0), (GATES, 1))
        self.curvature = np.tile(ridge * np.eye(N_INPUTS), (GATES, 1, 1))

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> None:
        self.curvature += curvature
        for g in range(GATES):
            change = np.linalg.solve(self.curvature[g], gradient[g])
            # Rounded, so that the order in which tasks' sums are added up doesn't show.
            self.weights[g] = np.round(self.weights[g] + np.clip(change, -0.5, 0.5), 9)


def sums(codes: np.ndarray, n: np.ndarray, x: np.ndarray, gate: np.ndarray, mixer: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """Gradient (gates x inputs) of the gain and its curvature (gates x pairs of inputs), over all occurrences."""
    bit, _ = bits(codes)
    p = squash(mixer.mix(x, gate))
    error, bend = ((bit - p) * n[:, None]).ravel(), (p * (1 - p) * n[:, None]).ravel()
    each = [c.ravel() for c in np.moveaxis(_with_constant(x), 1, 0)]
    flat = gate.ravel()
    return np.stack([np.bincount(flat, error * c, GATES) for c in each], axis=1), np.stack([np.bincount(flat, bend * each[i] * each[j], GATES) for i, j in PAIRS], axis=1)


def map_counts(codes: np.ndarray, n: np.ndarray, x: np.ndarray, gate: np.ndarray, mixer: Mixer) -> np.ndarray:
    """How often 0 and 1 came in each cell of the probability map (2 x cells)."""
    bit, so_far = bits(codes)
    low, part = _step(mixer.mix(x, gate))
    out = np.zeros((2, 256 * STEPS))
    place, mass = (so_far * STEPS + low).ravel(), np.repeat(n, 8)
    for shift, share in ((0, 1 - part), (1, part)):
        for value in (0, 1):
            out[value] += np.bincount(place + shift, mass * share.ravel() * (bit.ravel() == value), 256 * STEPS)
    return out


def refined_map(n0: np.ndarray, n1: np.ndarray, seen: float = 20.0) -> np.ndarray:
    """Probabilities of the map; every cell starts as if seen 20 times at its own probability."""
    p = np.tile(squash(np.linspace(-8, 8, STEPS)), 256)
    return np.round((n1 + seen * p) / (n0 + n1 + seen), 9).reshape(256, STEPS)


# ------------------------------------------------------------------ learning


def left_out_inputs(found: DataFrame, short_folder: str) -> DataFrame:
    """portion, key, n, x (16-bit numbers, orders x 8) and known (8 bytes) of every training run, with one occurrence of itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = None
        for keys, n, _ in grouped(batches):
            short = short or short_counts(short_folder)
            for codes, m, n0, n1 in _counted_slices(keys, n, short):
                bit = bits(codes)[0][:, None, :]
                x, gate = inputs(np.maximum(0, n0 - (1 - bit)), np.maximum(0, n1 - bit))
                portion = (mixed(codes.astype(np.uint64)) % np.uint64(PORTIONS)).astype(np.int32)
                numbers = x.astype("<f2").reshape(len(codes), -1)
                known = (gate // 8).astype(np.uint8)
                columns = [pa.array(portion), pa.array(codes), pa.array(m), *(pa.array([r.tobytes() for r in c], pa.binary()) for c in (numbers, known))]
                yield pa.RecordBatch.from_arrays(columns, ["portion", "key", "n", "x", "known"]).filter(pa.array(m > 0))

    return by_context(found).mapInArrow(run, "portion int, key long, n long, x binary, known binary")


def _counted_slices(keys: np.ndarray, n: np.ndarray, short: list[Counts]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs, their n, and the counts of their contexts, slice by slice. A slice holds whole contexts of three bytes or, of a larger one, all."""
    context = keys >> 8 & 0xFFFFFF
    at = 0
    while at < len(keys):
        end = min(at + SLICE, len(keys))
        if end < len(keys):
            whole = int(np.searchsorted(context[at:], context[end])) + at
            end = whole if whole > at else int(np.searchsorted(context[at:], context[at], "right")) + at
        n0, n1 = context_counts(keys[at:end], n[at:end], short)
        for a in range(at, end, SLICE):
            z = min(a + SLICE, end)
            yield keys[a:z], n[a:z], n0[a - at : z - at], n1[a - at : z - at]
        at = end


def _read_inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            m = part.num_rows
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<f2").reshape(m, ORDERS, 8).astype(np.float64)
            known = np.frombuffer(b"".join(part.column("known").to_pylist()), np.uint8).reshape(m, 8).astype(np.int64)
            yield part.column("key").to_numpy(), part.column("n").to_numpy(), x, known * 8 + np.arange(8)


def fit_mixer(learnt_from: DataFrame) -> Mixer:
    """Weights by a step for each portion of left_out_inputs(), then the probability map under these weights. What comes to the driver is
    27 numbers a gate and step, and the cells of the map."""
    learner = OnlineNewton()
    names = [f"s{k}" for k in range(N_INPUTS + len(PAIRS))]
    for portion in range(PORTIONS):
        mixer = Mixer(learner.weights.copy())

        def run(batches: Iterator[pa.RecordBatch], mixer: Mixer = mixer) -> Iterator[pa.RecordBatch]:
            total = np.zeros((GATES, len(names)))
            for part in _read_inputs(batches):
                total += np.concatenate(sums(*part, mixer), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES), pa.int32()), *(pa.array(c) for c in total.T)], ["gate", *names])

        some = learnt_from.filter(F.col("portion") == portion).select("key", "n", "x", "known")
        total = np.zeros((GATES, len(names)))
        for r in some.mapInArrow(run, "gate int, " + ", ".join(f"{c} double" for c in names)).groupBy("gate").agg(*(F.sum(c).alias(c) for c in names)).collect():
            total[r["gate"]] = r[1:]
        curvature = np.zeros((GATES, N_INPUTS, N_INPUTS))
        for k, (i, j) in enumerate(PAIRS):
            curvature[:, i, j] = curvature[:, j, i] = total[:, N_INPUTS + k]
        learner.step(total[:, :N_INPUTS], curvature)
    plain = Mixer(learner.weights)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 256 * STEPS))
        for part in _read_inputs(batches):
            n += map_counts(*part, plain)
        used = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[0, used]), pa.array(n[1, used])], ["cell", "n0", "n1"])

    n = np.zeros((2, 256 * STEPS))
    for r in learnt_from.select("key", "n", "x", "known").mapInArrow(refine, "cell int, n0 double, n1 double").groupBy("cell").agg(F.sum("n0"), F.sum("n1")).collect():
        n[:, r[0]] = r[1:]
    return Mixer(plain.weights, refined_map(*n))


def run_costs(found: DataFrame, short_folder: str, mixer: Mixer) -> DataFrame:
    """key, cost, seen of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = None
        for keys, n, seen in grouped(batches):
            short = short or short_counts(short_folder)
            cost = np.concatenate([mixer.costs(codes, n0, n1) for codes, _, n0, n1 in _counted_slices(keys, n, short)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cost), pa.array(seen)], ["key", "cost", "seen"])

    return by_context(found).mapInArrow(run, "key long, cost long, seen long")


# ------------------------------------------------------------------ scoring


def least_heavy(counts: DataFrame, by: str, most: int) -> int:
    """The least count, of about a tenth's steps, that no more than ``most`` rows reach. The table's counts come in 640 kinds at most."""
    kinds = counts.groupBy(F.floor(F.log2(F.col(by).cast("double")) * 10).cast("int").alias("kind")).agg(F.count("*").alias("rows"), F.max(by).alias("top")).orderBy(F.desc("kind")).collect()
    rows, least = 0, 1
    for r in kinds:
        rows += r["rows"]
        if rows > most:
            return least
        least = 2 ** (r["kind"] / 10)
        least = int(np.ceil(least - 1e-9))
    return 1


class Lookup:
    """Numbers by key, as sorted arrays, read from a table of two columns."""

    def __init__(self, folder: str) -> None:
        fs, path = open_fs(folder)
        found = pads.dataset(path, schema=pa.schema([("key", pa.int64()), ("value", pa.int64())]), filesystem=fs, format="parquet").to_table().sort_by("key")
        self.keys, self.values = found["key"].to_numpy(), found["value"].to_numpy()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 for keys that aren't there, and which are."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return np.where(there, self.values[at], 0), there


class Rest:
    """Keys of texts that are not looked up in place, with how often each occurs, as lists by text."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, text: np.ndarray, keys: np.ndarray, kind: int) -> None:
        if len(keys):
            self.parts.append((text, keys, np.full(len(keys), kind, np.int8)))

    def lists(self, n: int) -> list[pa.Array]:
        text, keys, kind = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)), *self.parts, strict=True))
        order = np.lexsort((keys, kind, text))
        text, keys, kind = text[order], keys[order], kind[order]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (kind[1:] != kind[:-1]) | (keys[1:] != keys[:-1]))) if len(text) else np.zeros(0, np.int64)
        at = pa.array(np.searchsorted(text[first], np.arange(n + 1)).astype(np.int32))
        times = np.diff(np.append(first, len(text)))
        return [pa.ListArray.from_arrays(at, pa.array(c, t)) for c, t in ((kind[first], pa.int8()), (keys[first], pa.int64()), (times, pa.int64()))]


def score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    ``is_training``: a condition on the rows that are learnt from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(is_training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    with Scratch(spark) as scratch:
        found = scratch.keep(gather(rows), "lm-counts", by="kind")
        words, all_runs = found.filter(F.col("kind") == WORD).select("key", "n"), found.filter(F.col("kind") == RUN).select("key", "n", "seen")
        n_docs = rows.filter("training").count()
        total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        n, v = int(total[1]) + n_docs, int(total[0]) + (n_docs > 0)
        short_folder, heavy_words, heavy_runs = (scratch.folder(f"lm-{x}") for x in ("short", "heavy-words", "heavy-runs"))
        all_runs.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("key")).agg(F.sum("n").alias("n")).write.parquet(short_folder)
        mixer = fit_mixer(scratch.keep(left_out_inputs(all_runs, short_folder), "lm-inputs", by="portion"))
        costs = scratch.keep(run_costs(all_runs, short_folder, mixer), "lm-costs")
        least_word, least_run = least_heavy(words, "n", HEAVY_WORDS), least_heavy(costs, "seen", HEAVY_RUNS)
        words.filter(F.col("n") >= least_word).select("key", F.col("n").alias("value")).write.parquet(heavy_words)
        costs.filter(F.col("seen") >= least_run).select("key", F.col("cost").alias("value")).write.parquet(heavy_runs)
        schema = "row long, doc_id long, training boolean, n_tokens long, n_known long, n_bytes long, known_sum double, cost long, kinds array<byte>, rare array<long>, times array<long>"
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word_counts, run_cost = Lookup(heavy_words), Lookup(heavy_runs)
            for part in pieces(batches, "text", PIECE):
                m = part.num_rows
                data, offsets = _lower(part.column("text"))
                rest, cost = Rest(), np.zeros(m)
                for codes, text in Places.of(data, offsets).slices():
                    which, distinct = pd.factorize(codes)
                    value, known = run_cost.find(distinct)
                    cost += np.bincount(text, value[which], m)  # sums of whole numbers
                    rare = np.flatnonzero(~known[which])
                    rest.add(text[rare], codes[rare], RUN)
                n_words, n_known, known_sum = np.ones(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
                for some, places in stretches(data, offsets, PIECE):
                    starts, ends, before = spans(some, places)
                    text = np.repeat(np.arange(m), np.diff(before))
                    key = hashes(some, starts, ends).view(np.int64)
                    which, distinct = pd.factorize(key)
                    value, known = word_counts.find(distinct)
                    n_words += np.diff(before)
                    known_sum += np.bincount(text, np.where(known, np.log10(value + 1.0), 0.0)[which], m)
                    n_known += np.bincount(text, known[which], m).astype(np.int64)
                    rare = np.flatnonzero(~known[which])
                    rest.add(text[rare], key[rare], WORD)
                sizes = [pa.array(x, pa.int64()) for x in (n_words, n_known, np.diff(offsets))]
                columns = [*(part.column(c) for c in ("row", "doc_id", "training")), *sizes, pa.array(known_sum), pa.array(cost.astype(np.int64)), *rest.lists(m)]
                yield pa.RecordBatch.from_arrays(columns, names)

        scored = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "training", "text").mapInArrow(run, schema), "lm-scored")
        rare = scored.select("row", F.explode(F.arrays_zip("kinds", "rare", "times")).alias("w")).select("row", F.col("w.kinds").alias("kind"), F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
        light = words.filter(F.col("n") < least_word).select(F.lit(WORD).cast("byte").alias("kind"), "key", F.col("n").alias("value"))
        light = light.unionByName(costs.filter(F.col("seen") < least_run).select(F.lit(RUN).cast("byte").alias("kind"), "key", F.col("cost").alias("value")))
        word = F.col("kind") == WORD
        rare = rare.join(light, ["kind", "key"]).groupBy("row").agg(
            F.sum(F.when(word, F.col("times") * F.log10(F.col("value") + 1.0))).alias("rare_sum"), F.sum(F.when(word, F.col("times"))).alias("rare_known"),
            F.sum(F.when(~word, F.col("times") * F.col("value"))).alias("rare_cost"),
        )
        both = scored.drop("kinds", "rare", "times").join(rare, "row", "left")
        base = F.col("known_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(float(np.log10(n_docs + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
        model = (F.col("cost") + F.coalesce("rare_cost", F.lit(0))).cast("double") * F.lit(-UNIT)
        known = F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + (1 if n_docs else 0)
        out = both.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"), "n_bytes")
        bits_per_byte = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
        return keep(out.withColumn("bits_per_byte", bits_per_byte).drop("n_bytes"), "lm-scores")
