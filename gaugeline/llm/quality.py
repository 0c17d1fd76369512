"""Quality by compression: one zstandard dictionary built from good, one from bad labelled text; the normalised difference of a
text's sizes under the two, put through a logistic curve fitted on labelled rows, is the score.

A text is compressed in blocks of BLOCK bytes, so that in a long text too the dictionaries count and not what the compressor
has learnt from the text itself; every byte of every text is in some block. Fitting is the one step on a sample: at most
``per_class`` labelled texts of each class, taken in the order of a hash of their ids, whatever their length; of one with more than
``per_text`` characters that many are learnt from, in blocks that are spread over all of it. Half of them build the
dictionaries, the others fit the curve, weighted to the classes' shares among all labels.

Defined results: null and empty texts compress alike under both dictionaries and get the score of a difference of zero;
texts of any length are scored whole; equal texts get equal scores; with labels of one class only, or none, every score is 0.5; an id with several labels counts with the largest;
labels without a text, texts without a label and labels other than 0 and 1 are not learnt from; rows are never dropped by scoring;
an empty table gives no rows; columns other than id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
DICT_BYTES = 112_640
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Raw dictionaries (empty: no model), and the curve's slope and intercept."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(size under bad - size under good) / bytes for each text.

        Over the raw length and not the compressed one: text that any dictionary compresses to nothing, such as one word
        repeated, then has a difference near zero, as bad text has, and not that of its few literal bytes.
        """
        sides = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            good = bad = 0
            for at in range(0, len(t), BLOCK):
                block = t[at : at + BLOCK]
                good += len(sides[0].compress(block))
                bad += len(sides[1].compress(block))
            out[i] = (bad - good) / max(1, len(t))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not (self.good and self.bad):
            return np.full(len(texts), 0.5)
        return _logistic(self.slope * self.differences(texts) + self.intercept)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary of DICT_BYTES at most; for too little text to train on, the text itself."""
    samples = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression by Newton's method, on x in units of its spread."""
    unit = float(np.std(x)) or 1.0
    a = np.column_stack([x / unit, np.ones_like(x)])
    beta = np.zeros(2)
    # Labels are smoothed as if each class had one more row on the other side, so that separable data has an optimum.
    soft = np.where(y == 1, (np.sum(y == 1) + 1) / (np.sum(y == 1) + 2), 1 / (np.sum(y == 0) + 2))
    for _ in range(50):
        p = _logistic(a @ beta)
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (soft - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / unit), float(beta[1])


def excerpt(text: Column, per_text: int) -> Column:
    """Texts of up to ``per_text`` characters whole; of longer ones that many, in blocks at equal distances from the first to the last."""
    n = max(2, per_text // BLOCK)
    at = lambda k: (F.lit(1) + F.floor(k * (F.length(text) - BLOCK) / F.lit(n - 1))).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(text, at(k), F.lit(BLOCK))), "")
    return F.when(F.length(text) > F.lit(n * BLOCK), spread).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, learn_from: Column | None = None, per_text: int = 65_536) -> Model:
    """Learn from labelled rows of ``docs`` (doc_id, text) for which ``learn_from`` (an expression over doc_id) holds."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known if learn_from is None else known.filter(learn_from)
    totals = {int(r["quality"]): r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model()
    drawn = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(ids, "doc_id")
    # Repeated rows of an id could exceed the bound: one row for each id.
    rows = rows.groupBy("doc_id", "quality").agg(F.min(excerpt(F.col("text"), per_text)).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    texts = {q: [r["text"].encode() for r in rows if r["quality"] == q] for q in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return Model()
    model = Model(build_dictionary(texts[1][::2]), build_dictionary(texts[0][::2]))
    held = {q: texts[q][1::2] for q in (0, 1)}
    x = model.differences(held[0] + held[1])
    y = np.repeat([0, 1], [len(held[0]), len(held[1])])
    weight = np.where(y == 1, totals[1] / len(held[1]), totals[0] / len(held[0])) * len(y) / sum(totals.values())
    return Model(model.good, model.bad, *fit_curve(x, y, weight))


def score(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts]))

    return scored(text)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
