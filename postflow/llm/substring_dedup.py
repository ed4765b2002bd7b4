"""Removal of repeated passages: every word covered by a window of words that also starts earlier in the corpus.

**Anchors.** Positions of a document are in the cover when their residue modulo 13 is 0, 1, 3 or 9. These residues are a
perfect difference set: for any two positions some shift below 13 brings both into the cover. So two equal windows of 20
words have an equal run of 8 words (an anchor) that lies in the cover in both, at the same place. Only anchors are hashed
and compared across the corpus, 4 for 13 words; windows around anchors that occur twice are the only ones that can repeat.
They are extended to 20 words, hashed in 128 bits and compared, and the first occurrence of each stays.

**Distribution.** Documents are dealt to cells of bounded size by a hash of id and text; the texts are shuffled once, and
that exchange serves all three passes over the cells. What cells send are arrays of hashes, each hash once per cell, so a
passage of a third of all documents sends one hash per cell. Hashes are dealt to buckets, which send back to the cells
the ones that other cells have too. No documents meet in pairs, and no group of copies meets in one task.

**Defined cases.** The order is by id (null last), then by the hash of the text, then by the start. Rows with equal id
and text are one document, reported as often as it occurs. Null and empty texts have no words, and nothing is removed
from texts of fewer than ``WINDOW`` words. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import exact_id, longs, text_of

WINDOW = 20
ANCHOR = 8
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Text of a cell. Its words, hashes and strings take some twenty times that in a task.
CELL_BYTES = 8 << 20
#: Words whose hashes a worker keeps.
MAX_WORDS = 500_000
#: Odd multipliers of the rolling hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

assert ANCHOR + PERIOD - 1 <= WINDOW

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LAST = np.iinfo(np.int64).max

RESULT = "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_sha256 STRING"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode())
        return value


_hashes = _Hashes()


class Cell(NamedTuple):
    """The distinct documents of a cell in order, their words in one array."""

    ids: np.ndarray  # null as the largest number
    keys: np.ndarray
    words: list[list[str]]
    hashes: np.ndarray
    first: np.ndarray  # of each document, and the number of words behind the last
    rows: list[int]  # how often each document occurs

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int64), np.diff(self.first))

    def starts(self, length: int) -> np.ndarray:
        """Where a run of ``length`` words of one document starts."""
        rest = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))
        return rest >= length

    def anchors(self) -> np.ndarray:
        """Starts of anchors in the cover, of documents with a window."""
        at = np.arange(len(self.hashes))
        within = at - np.repeat(self.first[:-1], np.diff(self.first))
        long = np.repeat(np.diff(self.first) >= WINDOW, np.diff(self.first))
        return np.flatnonzero(np.isin(within % PERIOD, COVER) & long & self.starts(ANCHOR))


def read_cell(docs: pd.DataFrame) -> Cell:
    counts = docs.groupby(["doc_id", "text_key", "text"], dropna=False, sort=False).size().reset_index(name="n")
    ids = np.array([_LAST if pd.isna(i) else int(i) for i in counts["doc_id"]], dtype=np.int64)
    keys = counts["text_key"].to_numpy(dtype=np.int64)
    order = np.lexsort((keys, ids))
    if len(_hashes) > MAX_WORDS:
        _hashes.clear()
    texts = counts["text"].to_numpy()
    words = [_WORDS.findall(texts[k]) for k in order]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hashes = np.fromiter((_hashes[w] for ws in words for w in ws), dtype=np.uint64, count=int(lengths.sum()))
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Cell(ids[order], keys[order], words, hashes, first, counts["n"].to_numpy()[order].tolist())


def rolled(words: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, by doubling: a run of 20 is one of 16 and one of 4."""
    factor, done, result = np.uint64(multiplier), 0, None
    power = words
    size = 1
    power_factor = factor
    while True:
        if length & size:
            if result is None:
                result, done = power, size
            else:  # the longer run first
                n = min(len(power), len(result) - size) if len(result) > size else 0
                result = power[:n] * _power(factor, done) + result[size : size + n]
                done += size
        size *= 2
        if size > length:
            return result[: max(0, len(words) - length + 1)]
        half = size // 2
        power = power[:-half] * power_factor + power[half:] if len(power) > half else power[:0]
        power_factor = power_factor * power_factor


def _power(factor: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(factor), n, 1 << 64))


def _at(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return hashes[at] if len(at) else np.empty(0, dtype=np.uint64)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Spreads the bits of sums, whose low bits are less mixed."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(MULTIPLIERS[1])
    return hashes ^ (hashes >> np.uint64(29))


def anchor_hashes(cell: Cell) -> tuple[np.ndarray, np.ndarray]:
    at = cell.anchors()
    return at, _mixed(_at(rolled(cell.hashes, ANCHOR, MULTIPLIERS[0]), at))


def window_hashes(cell: Cell, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_mixed(_at(rolled(cell.hashes, WINDOW, m), at)) for m in MULTIPLIERS)


def candidates(cell: Cell, shared: np.ndarray) -> np.ndarray:
    """Starts of windows with an anchor that occurs twice: in the cell, or here and in another cell."""
    at, hashes = anchor_hashes(cell)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    hot = at[(counts[inverse] > 1) | np.isin(hashes, shared)]
    change = np.zeros(len(cell.hashes) + 1, dtype=np.int64)
    np.add.at(change, hot + 1, -1)
    np.add.at(change, np.maximum(hot - (PERIOD - 1), cell.first[np.searchsorted(cell.first, hot, side="right") - 1]), 1)
    return np.flatnonzero((np.cumsum(change[:-1]) > 0) & cell.starts(WINDOW))


def local_firsts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether a window is the first of its kind; both hashes are in the order of the cell."""
    order = np.lexsort((np.arange(len(one)), two, one))
    a, b = one[order], two[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    result = np.empty(len(one), dtype=bool)
    result[order] = new
    return result


def _blob(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _array(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(b) for b in blobs), dtype=kind)


def _groups(keys: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each key, ascending, in the order of the keys; one sort, however many keys there are."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return iter(np.split(order, np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else ())


def _send_anchors(buckets: int):
    def send(docs: pd.DataFrame) -> pd.DataFrame:
        hashes = np.unique(anchor_hashes(read_cell(docs))[1])
        bucket = hashes % np.uint64(buckets)
        number = int(docs["cell"].iloc[0])
        rows = [(int(bucket[k[0]]), number, _blob(hashes[k], "<u8")) for k in _groups(bucket)]
        return pd.DataFrame(rows, columns=["bucket", "cell", "hashes"])

    return send


def _share_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """Hashes that more than one cell has sent, back to each of these cells."""
    hashes = _array(rows["hashes"], "<u8")
    cells = np.repeat(rows["cell"].to_numpy(dtype=np.int64), [len(b) // 8 for b in rows["hashes"]])
    order = np.argsort(hashes, kind="stable")
    hashes, cells = hashes[order], cells[order]
    same = np.zeros(len(hashes) + 1, dtype=bool)
    same[1:-1] = hashes[1:] == hashes[:-1]
    twice = same[1:] | same[:-1]
    cells, hashes = cells[twice], hashes[twice]
    found = [(int(cells[k[0]]), _blob(hashes[k], "<u8")) for k in _groups(cells)]
    return pd.DataFrame(found, columns=["cell", "hashes"])


def _send_windows(buckets: int):
    def send(docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "cell", "one", "two", "doc", "start", "ids", "keys"]
        if not len(docs):
            return pd.DataFrame([], columns=names)
        cell = read_cell(docs)
        at = candidates(cell, _array(shared["hashes"], "<u8"))
        one, two = window_hashes(cell, at)
        first = local_firsts(one, two)
        at, one, two = at[first], one[first], two[first]
        doc = cell.doc_of[at]
        start = at - cell.first[doc]
        bucket = one % np.uint64(buckets)
        number = int(docs["cell"].iloc[0])
        rows = []
        for here in _groups(bucket):
            used, index = np.unique(doc[here], return_inverse=True)
            arrays = ((one[here], "<u8"), (two[here], "<u8"), (index, "<u4"), (start[here], "<u4"), (cell.ids[used], "<i8"), (cell.keys[used], "<i8"))
            rows.append((int(bucket[here[0]]), number, *(_blob(*a) for a in arrays)))
        return pd.DataFrame(rows, columns=names)

    return send


def _find_later(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows that start earlier in another cell, back to the cells they come from."""
    ids, keys = [], []
    for r in rows.itertuples():
        index = np.frombuffer(r.doc, "<u4")
        ids.append(np.frombuffer(r.ids, "<i8")[index])
        keys.append(np.frombuffer(r.keys, "<i8")[index])
    one, two, start = _array(rows["one"], "<u8"), _array(rows["two"], "<u8"), _array(rows["start"], "<u4")
    cells = np.repeat(rows["cell"].to_numpy(dtype=np.int64), [len(b) // 8 for b in rows["one"]])
    order = np.lexsort((start, np.concatenate(keys), np.concatenate(ids), two, one))
    one, two, cells = one[order], two[order], cells[order]
    later = np.zeros(len(one), dtype=bool)
    later[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    one, two, cells = one[later], two[later], cells[later]
    found = [(int(cells[k[0]]), _blob(one[k], "<u8"), _blob(two[k], "<u8")) for k in _groups(cells)]
    return pd.DataFrame(found, columns=["cell", "one", "two"])


def _remove(docs: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if not len(docs):
        return pd.DataFrame([], columns=names)
    cell = read_cell(docs)
    at = np.flatnonzero(cell.starts(WINDOW))
    one, two = window_hashes(cell, at)
    # windows that can repeat: within the cell, or by what the buckets say
    sent = np.unique(np.stack([_array(later["one"], "<u8"), _array(later["two"], "<u8")], axis=1), axis=0)
    _, inverse, counts = np.unique(one, return_inverse=True, return_counts=True)
    some = (counts[inverse] > 1) | np.isin(one, sent[:, 0])
    at, one, two = at[some], one[some], two[some]
    repeated = ~local_firsts(one, two)
    if len(sent):
        # the second half is looked up among equal first halves, of which there is one but for collisions
        place = np.searchsorted(sent[:, 0], one)
        for shift in range(int(np.unique(sent[:, 0], return_counts=True)[1].max())):
            k = np.minimum(place + shift, len(sent) - 1)
            repeated |= (sent[k, 0] == one) & (sent[k, 1] == two)
    change = np.zeros(len(cell.hashes) + 1, dtype=np.int64)
    np.add.at(change, at[repeated], 1)
    np.add.at(change, at[repeated] + WINDOW, -1)
    gone = np.cumsum(change[:-1]) > 0
    rows = []
    for k, words in enumerate(cell.words):
        here = gone[cell.first[k] : cell.first[k + 1]]
        kept = [w for w, g in zip(words, here) if not g] if here.any() else words
        digest = hashlib.sha256(" ".join(kept).encode()).hexdigest()
        doc_id = None if cell.ids[k] == _LAST else int(cell.ids[k])
        rows += [(doc_id, len(words), int(here.sum()), digest)] * cell.rows[k]
    columns = dict(zip(names, zip(*rows) if rows else [()] * len(names)))
    return pd.DataFrame({**columns, "doc_id": longs(columns["doc_id"])})


def dedup(docs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words, joined by
    one space."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    cells = max(1, -(-total // cell_bytes))
    buckets = max(16, cells // 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(cells)))
    in_cells = exact_id(rows).groupBy("cell")
    anchors = in_cells.applyInPandas(_send_anchors(buckets), "bucket BIGINT, cell BIGINT, hashes BINARY")
    shared = anchors.groupBy("bucket").applyInPandas(_share_anchors, "cell BIGINT, hashes BINARY")
    windows = in_cells.cogroup(shared.groupBy("cell")).applyInPandas(
        _send_windows(buckets),
        "bucket BIGINT, cell BIGINT, one BINARY, two BINARY, doc BINARY, start BINARY, ids BINARY, keys BINARY",
    )
    later = windows.groupBy("bucket").applyInPandas(_find_later, "cell BIGINT, one BINARY, two BINARY")
    return in_cells.cogroup(later.groupBy("cell")).applyInPandas(_remove, RESULT)
