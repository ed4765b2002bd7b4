"""Near duplicates by circulant MinHash: signatures of two permutations, bands, and exact Jaccard verification.

**Signatures.** A shingle's hash is a place in a ring of ``RING`` places. One permutation shuffles the places; the other,
a table, gives them values. Coordinate ``k`` of a signature is the smallest value that a set's places have ``k`` steps
further in the ring: one table, shifted in a circle, stands for all the permutations of a signature. A place's part of
all coordinates is then a run of neighbours in the table. ``ROWS`` coordinates make a band, and sets with an equal band
meet. A pair at the threshold of 0.85 meets in none of 24 bands of five with a probability below one in a million.

**Verification.** Equal sets are one node. In each of ``TURNS`` rounds every band picks one of its nodes, which is verified
on the whole sets with all the others that it is not yet connected to; this leaves the band. Bands whose nodes are then in
one component are done. The others, few, are verified in blocks of ``BLOCK`` nodes: a task holds two blocks, finds the
pairs that meet in this band first and are not connected, counts what all of them have in common at once, and returns the
links that connect something. No pair is left out but those that are connected already.

**Distribution.** Texts are read twice and never shuffled; the sets of documents that meet others are written once, as
hashes. Copies of a set, a third of all documents, say, are one node with combined minima. Bands of one node only are
found by a combined minimum and maximum and dropped.

**Defined cases.** Words are those between space characters, with A-Z in lower case. A document with fewer words than a
shingle has them as its one shingle; one without words or with a null text has none, 0 shingles, and is a component of
its own. Rows with equal ids are documents of their own. A component's id is its smallest id that is not null; a row is
kept if its id is that, and one with a null id only if all ids of its component are null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import bound_batches, text_of, written
from postflow.llm.components import components
from postflow.llm.ngram_join import shingles

WORDS = 3
#: Documents are linked from this share on, in percent of the union.
PERCENT = 85
RING = 1 << 22
BANDS, ROWS = 24, 5
TURNS = 2
BLOCK = 512
#: Most ids that are sent to all executors to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Places whose runs are held at once, and columns of a block's matrix.
_PART, _COLUMNS = 2048, 4096


def permuted(places: np.ndarray, which: int) -> np.ndarray:
    """The image of places of the ring under the first or the second permutation: odd factors and shifts of bits are
    bijections of the numbers below a power of two."""
    mask, half = np.uint64(RING - 1), np.uint64((RING.bit_length() - 1) // 2)
    x = places.astype(np.uint64)
    for k in range(3):
        odd = np.uint64(xxhash.xxh3_64_intdigest(f"{which}:{k}:factor") | 1)
        add = np.uint64(xxhash.xxh3_64_intdigest(f"{which}:{k}:shift"))
        x = (x * odd + add) & mask
        x ^= x >> half
    return x


class _Runs:
    """The table of the second permutation as runs of neighbours, built once in a worker."""

    table: np.ndarray | None = None

    @classmethod
    def all(cls) -> np.ndarray:
        if cls.table is None:
            values = permuted(np.arange(RING), 1).astype(np.uint32)
            around = np.concatenate([values, values[: BANDS * ROWS - 1]])
            cls.table = np.lib.stride_tricks.sliding_window_view(around, BANDS * ROWS)
        return cls.table


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    places = permuted(hashes & np.uint64(RING - 1), 0)
    runs, least = _Runs.all(), None
    for start in range(0, len(places), _PART):
        part = runs[places[start : start + _PART]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band; keys of different bands differ."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _node(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _signed(words: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, known = [], [], [], {}
            for text in batch.column("text"):
                hashes = shingles(text.as_py(), words)
                node = _node(hashes)
                if node not in known:
                    known[node] = bands(signature(hashes)).tolist() if len(hashes) else []
                nodes.append(node)
                sizes.append(len(hashes))
                keys.append(known[node])
            columns = {"doc_id": batch.column("doc_id"), "node": pa.array(nodes, pa.binary()), "n": pa.array(sizes, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    return signed


def _hashed(words: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words) for text in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"node": pa.array([_node(h) for h in sets], pa.binary()), "hashes": pa.array([h.tobytes() for h in sets], pa.binary())})

    return hashed


def _similar(percent: int):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one, two in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (one, two))
                common = len(np.intersect1d(x, y, assume_unique=True))
                found.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return similar


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common: products of 0/1 matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[place]
    owner, place = owner[kept], number[place[kept]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(shared.sum()), _COLUMNS):
        low, high = np.searchsorted(place, (start, start + _COLUMNS))
        part = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        part[owner[low:high], place[low:high] - start] = 1
        total += part @ part.T
    common = total.astype(np.int64)
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def _spanning(pairs: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs of rows that connect different components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept = []
    for i, j in pairs.tolist():
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b:
            parent[a] = b
            kept.append((i, j))
    return kept


def _block_links(percent: int):
    def block_links(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the nodes of two blocks of one band (or within one block)."""
        keys = np.array(rows["bands"].tolist(), dtype=np.int64).reshape(len(rows), -1)
        sizes, labels, side = rows["n"].to_numpy(), rows["component"].to_numpy(), rows["side"].to_numpy()
        here = int(np.flatnonzero(keys[0] == rows["key"].iloc[0])[0])
        open_ = np.triu(labels[:, None] != labels[None, :], 1)
        open_ &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            open_ &= side[:, None] != side[None, :]
        for band in range(here):
            # what meets in an earlier band is verified there
            open_ &= keys[:, band, None] != keys[None, :, band]
        names = ["a", "b"]
        some = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
        if not len(some):
            return pd.DataFrame([], columns=names)
        sets = [np.frombuffer(rows["hashes"].iloc[k], dtype=np.uint64) for k in some]
        common = common_counts(sets)
        both = sizes[some][:, None] + sizes[some][None, :]
        linked = open_[np.ix_(some, some)] & (100 * common >= percent * (both - common))
        pairs = some[np.argwhere(linked)]
        nodes = rows["node"].tolist()
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in _spanning(pairs, labels)], columns=names)

    return block_links


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node`` and ``hashes`` of the nodes wanted. Of each node one document is read (with a null id, all that have none)."""
    chosen = written(nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("_id")), "met-nodes")
    ids = chosen.select("_id").distinct()
    if chosen.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_hashed(words), "node BINARY, hashes BINARY")
    # documents that only share their id with that of a node are left out
    return written(sets.join(chosen.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_similar(percent), "a BINARY, b BINARY")


def _placed(some: DataFrame, links: DataFrame | None) -> DataFrame:
    """The nodes of bands with their components so far."""
    if links is None:
        return some.withColumn("component", F.col("node"))
    return some.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mixed(placed: DataFrame, *more) -> DataFrame:
    """The bands that have nodes of several components."""
    ends = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *more)
    return ends.where("low <> high").drop("low", "high")


def links_of(docs: DataFrame, nodes: DataFrame, words: int, percent: int, turns: int, block: int) -> DataFrame:
    """Links (a, b) between nodes, enough to connect all that belongs together."""
    entries = nodes.select(F.explode("bands").alias("key"), "node")
    shared = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    some = written(entries.join(written(shared, "shared-bands"), "key", "left_semi"), "band-nodes")
    sets = _sets(docs, nodes, some.select("node").distinct(), words)
    links = None
    for turn in range(turns):
        placed = _placed(some, links)
        if links is not None:
            placed = written(placed, "placed-nodes")
        heads = _mixed(placed, F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("head"))
        met = written(placed.join(heads, "key").where("node <> head.node"), "met-bands")
        pairs = met.where("component <> head.component").select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
        found = _verified(pairs.distinct(), sets, percent)
        links = written(found if links is None else links.unionByName(found), "links")
        # a head is done with its band
        some = met.select("key", "node")
    placed = some if links is None else written(_placed(some, links), "placed-nodes")
    open_ = placed.join(_mixed(placed), "key", "left_semi")
    open_ = written(open_.select("key", "node", F.xxhash64("component").alias("component")), "open-bands")
    if open_.isEmpty():
        return links
    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
    split = open_.join(blocks, "key").withColumn("side", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("blocks")))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = split.join(nodes.select("node", "n", "bands"), "node").join(sets, "node").select(
        "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component", "n", "bands", "hashes"
    )
    more = rows.groupBy("key", "i", "j").applyInPandas(_block_links(percent), "a BINARY, b BINARY")
    return written(links.unionByName(more), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, turns: int = TURNS, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    if turns < 1:
        raise ValueError("at least one round picks heads")
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    signed = written(docs.mapInArrow(_signed(words), "doc_id BIGINT, node BINARY, n BIGINT, bands ARRAY<BIGINT>"), "signatures")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    labels = components(links_of(docs, nodes, words, percent, turns, block))
    placed = written(nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "node-components")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = placed.join(least, "component").select("node", "component_id")
    found = signed.select("doc_id", "node", "n").join(of_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
