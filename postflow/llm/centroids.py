"""Clusters of vectors around centroids in exact integers, with distances from dictionaries of subvectors.

**Encoding.** Vectors become integers ``floor(256 x)`` and are kept in cells of ``CELL`` vectors. A cell cuts them into
blocks of ``WIDTH`` dimensions; for each block it holds the different subvectors that occur, and for each vector a code of
two bytes a block. Nothing is lost: the codes give the integers back.

**Rounds.** In each round a cell computes the squared distance of every subvector to the same block of every centroid,
once, and a vector's distances are the sums of these by its codes. The sums of a cluster's components come the same way:
counts by code times subvectors. A cell sends one row of sums per cluster, which are added before and after a shuffle of
nothing else; the driver sees at most one row per cluster. All sums are integers, so the order of additions is nothing.

**Distribution.** The cells are written once, and each round reads them; vectors are never shuffled. What a task holds is
one cell: its codes, one block's distances, and the vectors' distances to all centroids.

**Defined cases.** A vector that is null, has another number of components, or holds a null, NaN or infinite one is left
out. With fewer vectors than centroids there are fewer centroids, with none no rows. A null id counts as the largest
start; rows with equal ids are vectors of their own and start in the order of their components. Components of 2^18 and
more, whose squared distances can exceed a long, are an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import bound_batches, written

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Vectors of a cell (codes have two bytes, so at most 2^16), and dimensions of a block.
CELL = 1 << 15
WIDTH = 2
#: Integers are smaller than this, so that a distance fits a long.
LARGEST = SCALE << 18

_CELL_TYPE = "ids BINARY, known BINARY, largest BIGINT, dictionaries ARRAY<BINARY>, codes ARRAY<BINARY>"


def encoded(vectors: np.ndarray, width: int = WIDTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block of dimensions its different subvectors, and the code of every vector."""
    dictionaries, codes = [], []
    for start in range(0, vectors.shape[1], width):
        block = vectors[:, start : start + width]
        # subvectors as one integer each, if they are small enough to be sorted as such
        low = block.min(axis=0) if len(block) else np.zeros(block.shape[1], dtype=np.int64)
        spans = [int(s) + 1 for s in (block.max(axis=0) - low)] if len(block) else []
        room = 1
        for span in spans:
            room *= span
        if room < 1 << 62:
            one = np.zeros(len(block), dtype=np.int64)
            for k, span in enumerate(spans):
                one = one * span + (block[:, k] - low[k])
            _, first, code = np.unique(one, return_index=True, return_inverse=True)
            different = block[first]
        else:
            different, code = np.unique(block, axis=0, return_inverse=True)
        dictionaries.append(different)
        codes.append(code.reshape(-1).astype(np.uint16))
    return dictionaries, codes


def decoded(dictionaries: list[np.ndarray], codes: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([d[c] for d, c in zip(dictionaries, codes)], axis=1)


def _cells(dimensions: int, cell: int, width: int):
    def one(ids: list[np.ndarray], known: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(vectors)
        largest = int(np.abs(whole).max())
        if largest >= LARGEST:
            raise ValueError(f"a component of {largest / SCALE} is too large for distances in a long")
        dictionaries, codes = encoded(whole.astype(np.int64), width)
        row = {
            "ids": np.concatenate(ids).tobytes(),
            "known": np.concatenate(known).tobytes(),
            "largest": largest,
            "dictionaries": [d.tobytes() for d in dictionaries],
            "codes": [c.tobytes() for c in codes],
        }
        return pa.RecordBatch.from_pylist([row], schema=_CELL_SCHEMA)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, vectors, held = [], [], [], 0
        for batch in batches:
            at = 0
            every = batch.column("id")
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = np.floor(SCALE * flat.reshape(-1, dimensions))
            valid = every.is_valid().to_numpy(zero_copy_only=False)
            numbers = every.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            while at < len(rows):
                take = min(cell - held, len(rows) - at)
                here = slice(at, at + take)
                ids.append(numbers[here])
                known.append(valid[here])
                vectors.append(rows[here])
                held, at = held + take, at + take
                if held == cell:
                    yield one(ids, known, vectors)
                    ids, known, vectors, held = [], [], [], 0
        if held:
            yield one(ids, known, vectors)

    return cells


_CELL_SCHEMA = pa.schema(
    [
        ("ids", pa.binary()),
        ("known", pa.binary()),
        ("largest", pa.int64()),
        ("dictionaries", pa.list_(pa.binary())),
        ("codes", pa.list_(pa.binary())),
    ]
)


class _Cell:
    """One cell in a task."""

    def __init__(self, row: dict, width: int) -> None:
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.largest = row["largest"]
        self.codes = [np.frombuffer(c, dtype=np.uint16) for c in row["codes"]]
        blocks = [np.frombuffer(d, dtype=np.int64) for d in row["dictionaries"]]
        full = sum(len(b) for b in blocks) and width
        self.dictionaries = [b.reshape(-1, full) for b in blocks[:-1]]
        # the last block may be narrower
        self.dictionaries.append(blocks[-1].reshape(int(self.codes[-1].max()) + 1, -1))

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the nearest centroid, the smaller number where several are, and the squared distance."""
        reach = self.largest + int(np.abs(centroids).max())
        kind = np.int32 if reach * reach * centroids.shape[1] < 1 << 31 else np.int64
        total = np.zeros((len(self.ids), len(centroids)), dtype=kind)
        here, start = np.empty_like(total), 0
        for subvectors, codes in zip(self.dictionaries, self.codes):
            part = np.zeros((len(subvectors), len(centroids)), dtype=kind)
            for k in range(subvectors.shape[1]):
                apart = (subvectors[:, k, None] - centroids[None, :, start + k]).astype(kind)
                part += apart * apart
            np.take(part, codes, axis=0, out=here, mode="clip")
            total += here
            start += subvectors.shape[1]
        nearest = total.argmin(axis=1)
        return nearest, total[np.arange(len(total)), nearest].astype(np.int64)

    def sums(self, nearest: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each cluster the number of vectors and the sums of their components."""
        parts = []
        for subvectors, codes in zip(self.dictionaries, self.codes):
            m = len(subvectors)
            counts = np.bincount(nearest * m + codes, minlength=clusters * m).reshape(clusters, m)
            parts.append(counts @ subvectors)
        return np.bincount(nearest, minlength=clusters), np.concatenate(parts, axis=1)


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Cell]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _Cell(batch.slice(k, 1).to_pylist()[0], width)


def _summed(centroids: np.ndarray, width: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _each(batches, width):
            nearest, _ = cell.assigned(centroids)
            n, sums = cell.sums(nearest, len(centroids))
            there = np.flatnonzero(n)
            rows = {"cluster": pa.array(there, pa.int32()), "n": pa.array(n[there], pa.int64()), "sums": pa.array(sums[there].tolist(), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(rows)

    return summed


def _labelled(centroids: np.ndarray, width: int):
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _each(batches, width):
            nearest, distance = cell.assigned(centroids)
            ids = pa.array(cell.ids, pa.int64(), mask=~cell.known)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(nearest, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return labelled


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id`` and ``embedding`` of the vectors with so many components, all of them finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == dimensions) & finite)


def starts(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The first centroids: vectors by the SHA-256 of their ids."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("h"), "embedding").orderBy(F.col("h").asc_nulls_last(), "embedding").limit(clusters).collect()
    return np.array([[int(np.floor(SCALE * x)) for x in r["embedding"]] for r in first], dtype=np.int64)


def moved(cells: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; those without vectors stay."""
    sums = cells.mapInArrow(_summed(centroids, width), "cluster INT, n BIGINT, sums ARRAY<BIGINT>")
    dimensions = centroids.shape[1]
    added = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(dimensions)]).alias("sums"))
    after = centroids.copy()
    # one row per centroid
    for r in added.collect():
        after[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return after


def name_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, cell: int = CELL, width: int = WIDTH
) -> DataFrame:
    """One row per usable vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``,
    ``centroid_sha256``."""
    if cell > 1 << 16:
        raise ValueError("codes of two bytes need cells of at most 65536 vectors")
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, dimensions)
    centroids = starts(rows, clusters, seed)
    result = "vec_id BIGINT, cluster INT, distance BIGINT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING"
    if not len(centroids):
        return spark.createDataFrame([], result)
    if np.abs(centroids).max() >= LARGEST:
        raise ValueError("a component is too large for distances in a long")
    cells = written(rows.mapInArrow(_cells(dimensions, cell, width), _CELL_TYPE), "vector-cells")
    for _ in range(rounds):
        centroids = moved(cells, centroids, width)
    labelled = written(cells.mapInArrow(_labelled(centroids, width), "vec_id BIGINT, cluster INT, distance BIGINT"), "vector-clusters")
    inertia = {r["cluster"]: r["s"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(k, s, sum(inertia.values()), name_of(centroids[k])) for k, s in inertia.items()]
    about = spark.createDataFrame(named, "cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING")
    # at most one row per centroid
    return labelled.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
