"""The language model against a plain version of it: dictionaries of contexts, and loops over runs and bits."""

import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("gaugeline.llm")
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gaugeline.llm import bytes as B  # noqa: E402
from gaugeline.llm import lm_score as L  # noqa: E402


def trained(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


def plain_runs(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    padded = bytes(4) + raw + b"\0"
    return [padded[k : k + 5] for k in range(len(raw) + 1)]


class PlainModel:
    """All counts by exact context; weights, map and costs one bit at a time."""

    def __init__(self, texts):
        self.seen, self.counts = {}, {}
        for t in texts:
            for r in plain_runs(t):
                self.seen[r] = self.seen.get(r, 0) + 1
        for r, n in self.seen.items():
            for c, bit in self.contexts(r):
                for k in c:
                    self.counts.setdefault(k, [0, 0])[bit] += n
        self.learner, self.table = L.OnlineNewton(), None
        for portion in range(L.PORTIONS):
            gradient, curvature = np.zeros((L.GATES, 6)), np.zeros((L.GATES, 6, 6))
            for r, n in self.seen.items():
                if int(L.mixed(np.array([int.from_bytes(r, "big")], np.uint64))[0]) % L.PORTIONS == portion:
                    for x, gate, bit, _ in self.bits(r, True):
                        p = 1 / (1 + math.exp(-self.mix(x, gate)))
                        gradient[gate] += n * (bit - p) * x
                        curvature[gate] += n * p * (1 - p) * np.outer(x, x)
            self.learner.step(gradient, curvature)
        n = np.zeros((2, 256 * L.STEPS))
        for r, m in self.seen.items():
            for x, gate, bit, so_far in self.bits(r, True):
                low, part = self.cell(self.mix(x, gate))
                n[bit, so_far * L.STEPS + low] += m * (1 - part)
                n[bit, so_far * L.STEPS + low + 1] += m * part
        if self.seen:
            self.table = L.refined_map(*n)

    @staticmethod
    def contexts(run):
        """Of each bit of the last byte: its five contexts, and the bit."""
        byte = run[4]
        for j in range(8):
            yield [(run[4 - k : 4], j, byte >> 8 - j) for k in range(5)], byte >> 7 - j & 1

    def bits(self, run, left_out):
        for j, (contexts, bit) in enumerate(self.contexts(run)):
            x, known = [], 0
            for k, c in enumerate(contexts):
                n = list(self.counts.get(c, (0, 0)))
                if left_out:
                    n[bit] -= 1
                v = math.log((n[1] + L.PRIOR) / (n[0] + L.PRIOR))
                x.append(float(np.float16(v)) if left_out else v)
                known += k > 0 and sum(n) >= 2
            yield np.array([*x, 0.3]), known * 8 + j, bit, 1 << j | run[4] >> 8 - j

    def mix(self, x, gate):
        return max(-12.0, min(12.0, float(x @ self.learner.weights[gate])))

    @staticmethod
    def cell(z):
        at = (max(-7.999, min(7.999, z)) + 8) * (L.STEPS - 1) / 16
        return int(at), at - int(at)

    def score(self, text):
        total = 0
        for r in plain_runs(text):
            cost = 0.0
            for x, gate, bit, so_far in self.bits(r, False):
                z = self.mix(x, gate)
                p = 1 / (1 + math.exp(-z))
                if self.table is not None:
                    low, part = self.cell(z)
                    p = 0.5 * p + 0.5 * ((1 - part) * self.table[so_far, low] + part * self.table[so_far, low + 1])
                p = min(1 - 1e-7, max(1e-7, p))
                cost -= math.log10(p if bit else 1 - p)
            total += round(cost / L.UNIT)
        return -total * L.UNIT


def texts():
    rng = random.Random(5)
    names = [rng.choice(["ka", "lo", "mi", "Tür", "né"]) + rng.choice(["ra", "sto", "ven", ""]) for _ in range(30)]
    rows = [(k, " ".join(rng.choice(names) for _ in range(rng.randrange(1, 25)))) for k in range(40)]
    return [*rows, (None, "null id"), (90, None), (91, ""), (92, "zq \x00 xw"), (3, rows[3][1]), (93, rows[4][1])]


def test_scores_equal_the_plain_model(spark, monkeypatch):
    rows = texts()
    plain = PlainModel([t for i, t in rows if trained(i)])
    want = sorted((i is None, i or 0, plain.score(t)) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit("x"))
    for parts, heavy, piece in ((1, 1 << 20, 1 << 20), (7, 20, 64), (211, 0, 1 << 20)):
        monkeypatch.setattr(L, "HEAVY_RUNS", heavy)
        monkeypatch.setattr(L, "HEAVY_WORDS", heavy)
        monkeypatch.setattr(L, "PIECE", piece)
        got = L.score(docs.repartition(parts), L.training(F.col("doc_id"))).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [w[:2] for w in want]
        assert [x[2] for x in sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in got)] == pytest.approx([w[2] for w in want], abs=1e-5)
        # Equal, not nearly equal, however rows are dealt to tasks.
        scores = sorted((str(r["doc_id"]), r["score"], round(r["base_score"], 9)) for r in got)
        first = scores if parts == 1 else first
        assert scores == first


def test_probabilities_of_all_next_bytes_sum_to_one():
    plain = PlainModel([t for _, t in texts()])
    mixer = L.Mixer(plain.learner.weights, plain.table)
    codes = np.sort(np.array([int.from_bytes(r, "big") for r in plain.seen], np.int64))
    n = np.array([plain.seen[int(c).to_bytes(5, "big")] for c in codes])
    short = []
    for k in range(3):
        keys, which = np.unique(codes & (1 << 8 * (k + 1)) - 1, return_inverse=True)
        short.append(L.Counts(keys, np.bincount(which, n)))
    # The table holds one context of three bytes with all its runs, and all possible ones.
    context = int.from_bytes(b"ra k"[:4], "big") << 8
    own = codes[(codes >> 8 & 0xFFFFFF) == (context >> 8 & 0xFFFFFF)]
    every = np.unique(np.concatenate([own, context + np.arange(256)]))
    counts = np.array([plain.seen.get(int(c).to_bytes(5, "big"), 0) for c in every])
    n0, n1 = L.context_counts(every, counts, short)
    costs = mixer.costs(every, n0, n1)
    assert (10 ** (-costs[np.isin(every, context + np.arange(256))] * L.UNIT)).sum() == pytest.approx(1, abs=1e-4)


def test_model_learns(spark):
    """Seen texts cost less than like ones that are held out, and these less than noise."""
    rng = random.Random(2)
    line = lambda k: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "dog", "ran"]) for _ in range(40))
    noise = "".join(chr(rng.randrange(33, 126)) for _ in range(160))
    docs = spark.createDataFrame([*((k, line(k)) for k in range(200)), (1000, noise)], "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in L.score(docs, F.col("doc_id") < 190).collect()}
    learnt, held = np.mean([got[k] for k in range(190)]), np.mean([got[k] for k in range(190, 200)])
    assert learnt < held + 0.1 and held < 1.2 and got[1000] > 6


def test_a_very_long_text_is_taken_in_portions(spark, monkeypatch):
    """One text longer than many portions scores as in one."""
    rng = random.Random(3)
    rows = [(1, " ".join(f"w{rng.randrange(50)}" for _ in range(20_000)) + "x" * 3000), (2, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for piece in (1 << 20, 1000):
        monkeypatch.setattr(L, "PIECE", piece)
        found.append(sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["score"]) for r in L.score(docs, F.lit(True)).collect()))
    assert found[0] == found[1]


def test_runs_of_slices_are_those_of_texts():
    data, offsets = B.utf8(pa.array(["ab", None, "", "abcdefgh" * 5, "z"]))
    whole = [int.from_bytes(r, "big") for t in ("ab", "", "", "abcdefgh" * 5, "z") for r in plain_runs(t)]
    text = np.repeat(np.arange(5), np.diff(offsets) + 1).tolist()
    for most in (1, 2, 7, 1000):
        found = list(L.Places.of(data, offsets).slices(most))
        assert np.concatenate([c for c, _ in found]).tolist() == whole and np.concatenate([t for _, t in found]).tolist() == text
