"""Centroid clustering of whole-number vectors with partial-distance search.

Vectors are quantised to integers, so that distances, sums and centroids are exact and the same for any order of rows.
An assignment compares a block of vectors with one centroid after the other and adds up squared differences over a few
dimensions at a time, those of the highest variance first; a vector gives a centroid up once its partial distance is strictly
above the best distance it has, as the rest can only add to it, and only survivors see all dimensions. Ties go to the smaller
number: a later centroid must be strictly nearer.

A round is one pass over the vectors. Each task sums its vectors by cluster in memory of k x d numbers and returns k rows at
most, which Spark adds up; only k x d sums come to the driver. So a cluster that holds all vectors is no different from others.

Defined results: vectors of another length, or with a null or non-finite component, are not kept and have no row; rows that repeat
are vectors of their own; vectors of one id that tie for a starting place are ordered by their components; a null id hashes as the empty
string; fewer kept vectors than centroids make fewer centroids; an empty table gives no rows; components beyond 2^62 after
scaling count as 2^62, and distances and sums of distances beyond the range of long as its greatest value; only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.storage import Scratch, keep

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Dimensions that are added up between two checks of the partial distance.
STRIDE = 8
#: Rows that are compared at once.
BLOCK = 4096
#: Up to this size of components, squared distances over up to 2^7 dimensions fit 64 bits.
NARROW = 1 << 26
MOST = (1 << 63) - 1


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """Whole-number components, floor(scale * x), of a vector column."""
    limit = float(1 << 62)
    return F.transform(embedding.cast("array<double>"), lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-limit)), F.lit(limit))).cast("long"), F.lit(-(1 << 62))), F.lit(1 << 62)))


def kept(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of long) of the vectors of the right length whose components are all finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.filter((F.size(v) == components) & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("vec_id"), quantised(v, scale).alias("v"))


def starts(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose ids have the least hashes, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.orderBy(name, "v").limit(k).select("v").collect()]


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance for each row of x. order: dimensions, those to be looked at first at the front."""
    x, centroids = x[:, order], centroids[:, order]
    best = np.full(len(x), MOST, x.dtype)
    if x.dtype == object:
        best[:] = [int((d * d).sum()) for d in x - centroids[0]]
    which = np.zeros(len(x), np.int32)
    for c, centroid in enumerate(centroids):
        alive, partial = np.arange(len(x)), np.zeros(len(x), x.dtype)
        for at in range(0, x.shape[1], stride):
            d = x[alive, at : at + stride] - centroid[at : at + stride]
            partial = partial + (d * d).sum(axis=1)
            going = partial <= best[alive]
            alive, partial = alive[going], partial[going]
            if not len(alive):
                break
        nearer = (partial < best[alive]) | (c == 0)
        best[alive[nearer]], which[alive[nearer]] = partial[nearer], c
    return which, best


def _blocks(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, components)


def _assigned(x: np.ndarray, centroids: list[list[int]], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As nearest(); rows too large for 64-bit arithmetic go through Python's integers."""
    table = np.array(centroids, np.int64)
    large = np.abs(x).max(axis=1) > NARROW if np.abs(table).max() <= NARROW else np.ones(len(x), bool)
    which, distance = nearest(x, table, order)
    if large.any():
        some, far = nearest(x[large].astype(object), table.astype(object), order)
        which[large], distance[large] = some, [min(int(d), MOST) for d in far]
    return which, distance


def _sums(vectors: DataFrame, centroids: list[list[int]], order: list[int], components: int, squares: bool = False) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum (or sum of squares) of each cluster's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, components), object)
        for _, x in _blocks(batches, components):
            which = _assigned(x, centroids, np.array(order))[0] if k > 1 else np.zeros(len(x), np.int32)
            wide = (np.abs(x).max() if len(x) else 0) > NARROW or squares
            for c in np.unique(which).tolist():
                own = x[which == c]
                own = own.astype(object) if wide else own
                count[c] += len(own)
                total[c] += (own * own if squares else own).sum(axis=0)
        there = np.flatnonzero(count)
        sums = [[str(int(v)) for v in total[c]] for c in there]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(count[there]), pa.array(sums, pa.list_(pa.string()))], ["cluster", "n", "sums"])

    parts = vectors.select("vec_id", "v").mapInArrow(run, "cluster int, n long, sums array<string>")
    # Squares of the largest components may pass 38 digits; they only order dimensions.
    kind = "double" if squares else "decimal(38,0)"
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast(kind)).alias(f"s{d}") for d in range(components)])
    return {r["cluster"]: (r["n"], [r[f"s{d}"] if squares else int(r[f"s{d}"]) for d in range(components)]) for r in added.collect()}


def by_variance(vectors: DataFrame, components: int = COMPONENTS) -> list[int]:
    """Dimensions from the highest to the lowest variance over all vectors."""
    none = [[0] * components]
    n, sums = _sums(vectors, none, [], components).get(0, (0, []))
    squares = _sums(vectors, none, [], components, squares=True).get(0, (0, []))[1]
    if not n:
        return list(range(components))
    return sorted(range(components), key=lambda d: (-(float(squares[d]) / n - (float(sums[d]) / n) ** 2), d))


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS) -> tuple[list[list[int]], list[int]]:
    """Centroids after so many rounds, and the order of dimensions. vectors: as from kept()."""
    centroids, order = starts(vectors, k, seed), by_variance(vectors, components)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _sums(vectors, centroids, order, components).items():
            centroids[c] = [s // n for s in sums]
    return centroids, order


def assign(vectors: DataFrame, centroids: list[list[int]], order: list[int], components: int = COMPONENTS) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    kind = vectors.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, components):
            which, distance = _assigned(x, centroids, np.array(order))
            yield pa.RecordBatch.from_arrays([ids, pa.array(which, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.select("vec_id", "v").mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components) for every kept vector."""
    with Scratch(vectors.sparkSession) as scratch:
        own = scratch.keep(kept(vectors, components, scale, id_col, vector_col), "vectors")
        centroids, order = fit(own, k, rounds, seed, components)
        rows = scratch.keep(assign(own, centroids, order, components), "assigned")
        per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster"))
        # k rows at most.
        totals = [(r["cluster"], int(r["of_cluster"])) for r in per.collect()]
        shown = vectors.sparkSession.createDataFrame([(c, min(t, MOST), min(sum(x for _, x in totals), MOST), centroids[c]) for c, t in totals], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
        return keep(rows.join(F.broadcast(shown), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"), "clusters")


def digest(centroid: Column) -> Column:
    """SHA-256 of a centroid's components, in decimal and joined by commas."""
    return F.sha2(F.concat_ws(",", F.transform(centroid, lambda x: x.cast("string"))), 256)

