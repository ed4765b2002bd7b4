"""Documents that contain benchmark items, also with edits: CGK embedding, bit-sampling LSH, exact edit distance.

**Embedding.** A random walk reads a window: at step j it writes the character it stands on and moves on or not, as a
random bit for j and the character says. Two windows with few edits between them soon walk in step again after each, so
few of their written characters differ: edit distance becomes Hamming distance.

**LSH.** The key of a window is its characters at a few sampled steps. Each of ``REPEATS`` repetitions has bits and
samples of its own. Windows start at every word of items and at every word of documents, so one of them without or with
harmless edits is enough, and the chance that none meets its key falls with the power of windows times repetitions. A
walk over a document ends early where no item has the characters sampled so far; that changes no result.

**Verification.** A document and an item that share a key are aligned around its place: the item against any part of
the text there, with edits at most a fifth of the item's length, exactly, by a bit-parallel distance.

Items and documents are compared in lower case, with letters and digits only and single spaces between words.

**Distribution.** Documents are read in one narrow pass for each block of items. A block is bounded by ``BLOCK_ITEMS``
and ``BLOCK_CHARS``; only blocks are collected and sent to tasks. More items make more passes, not larger ones.

**Defined cases.** Null and empty texts contain nothing. Items with fewer than ``MIN_CHARS`` characters are no evidence
and never found; null items neither. Rows are read one by one: repeated documents are all reported, and items with equal
ids as one. Other columns of documents are kept by :func:`clean_documents` and not read by :func:`leaks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from postflow.llm.common import bound_batches, exact_id, text_of

#: Most edits, as a share of an item's length.
MAX_EDITS = 0.2
MIN_CHARS = 16
REPEATS = 3
#: Steps of the walk and sampled steps, for items of at least so many characters.
WALKS = ((48, 40, 12), (MIN_CHARS, 22, 8))
#: After so many sampled steps a walk ends if no item has these characters, and the bits of the table that says so.
SIEVED = (2, 3, 4, 6)
SIEVE_BITS = 20
SEED = 20240229
#: Characters of texts whose windows walk together (one text at least), and alignments that go on together.
PART_CHARS = 4 << 20
ALIGNED = 1024
BLOCK_ITEMS = 50_000
BLOCK_CHARS = 8 << 20

_NO_WORDS = re.compile(r"[\W_]+")


class Walk:
    """One repetition: ``bits[step, character]``, the sampled steps, and what the items have at the first of these."""

    def __init__(self, bits: np.ndarray, sampled: np.ndarray):
        self.bits = bits
        self.sampled = sampled
        self.sieves = {n: np.zeros(1 << SIEVE_BITS, dtype=bool) for n in SIEVED if n < len(sampled)}

    def keys(self, characters: np.ndarray, starts: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which windows reach their end, their keys, and where they end. Characters are padded with zeros.

        With ``learn`` all do, and the sieves remember them.
        """
        places = np.arange(len(starts))
        at = starts.astype(np.int32)
        last = np.int32(len(characters) - 1)
        key = np.zeros(len(at), dtype=np.uint64)
        sampled, n = set(self.sampled.tolist()), 0
        for step in range(int(self.sampled[-1]) + 1):
            here = characters[at]
            if step in sampled:
                key = key * np.uint64(0x9E3779B97F4A7C15) + here + np.uint64(1)
                n += 1
                if n in self.sieves:
                    hashed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SIEVE_BITS)
                    if learn:
                        self.sieves[n][hashed] = True
                    else:
                        left = np.flatnonzero(self.sieves[n][hashed])
                        places, at, key, here = places[left], at[left], key[left], here[left]
            at = np.minimum(at + self.bits[step][here], last)
        return places, key ^ (key >> np.uint64(32)), at


def walks(steps: int, samples: int) -> list[Walk]:
    random = np.random.default_rng([SEED, steps])
    return [
        Walk(random.integers(0, 2, (steps, 256), dtype=np.int32), np.sort(random.choice(steps, samples, replace=False)))
        for _ in range(REPEATS)
    ]


def _normal(text: str) -> str:
    return _NO_WORDS.sub(" ", text.lower()).strip(" ")


def normalised(text: str) -> tuple[list[str], str]:
    """The words of a text, and these with single spaces between."""
    normal = _normal(text)
    return normal.split(), normal


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _characters(text: str) -> np.ndarray:
    """Characters as bytes, with one zero behind them."""
    points = _points(text)
    return np.append((points ^ (points >> 8)) & 0xFF, 0).astype(np.uint8)


def _word_starts(text: str) -> np.ndarray:
    """Where the words of a normalised text start."""
    points = _points(text)
    return np.append(0, np.flatnonzero(points == 32) + 1) if len(points) else np.empty(0, dtype=np.int64)


def best_match(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Fewest edits between ``item`` and any part of ``text``, if at most ``most``, and where that part first ends."""
    edits, end = best_matches([(item, text)])[0]
    return (edits, end) if end and edits <= most else None


def best_matches(pairs: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """For each pair (item, text) the fewest edits between the item and any part of the text, and where it ends.

    Bit-parallel: bit vectors hold the differences down a column of the distance matrix, 64 rows in a word; pairs whose
    items have as many words go through their texts together.
    """
    found = [(0, 0)] * len(pairs)
    by_size: dict[int, list[int]] = {}
    for k in sorted(range(len(pairs)), key=lambda k: len(pairs[k][1])):
        by_size.setdefault(-(-len(pairs[k][0]) // 64), []).append(k)
    for size, members in by_size.items():
        for i in range(0, len(members), ALIGNED):
            some = members[i : i + ALIGNED]
            for k, edits, end in zip(some, *_aligned([pairs[k] for k in some], size)):
                found[k] = edits, end
    return found


def _aligned(pairs: list[tuple[str, str]], size: int) -> tuple[list[int], list[int]]:
    one = np.uint64(1)
    numbers = {item: n for n, item in enumerate(dict.fromkeys(item for item, _ in pairs))}
    points = np.unique(_points("".join(numbers)))
    masks = np.zeros((size, len(numbers), len(points) + 1), dtype=np.uint64)
    for item, n in numbers.items():
        for i, c in enumerate(np.searchsorted(points, _points(item)).tolist()):
            masks[i // 64, n, c] |= one << np.uint64(i % 64)
    # characters of no item, and those behind a text, match nothing: they end no part with fewer edits
    texts = np.full((len(pairs), max(len(t) for _, t in pairs)), len(points), dtype=np.int32)
    for row, (_, text) in zip(texts, pairs):
        here = _points(text)
        at = np.minimum(np.searchsorted(points, here), len(points) - 1)
        row[: len(here)] = np.where(points[at] == here, at, len(points))
    own = np.array([numbers[item] for item, _ in pairs], dtype=np.int32) * np.int32(len(points) + 1)
    texts = np.ascontiguousarray((texts + own[:, None]).T)
    masks = masks.reshape(size, -1)
    lengths = np.array([len(item) for item, _ in pairs])
    top = ((lengths - 1) % 64).astype(np.uint64)
    up = [np.full(len(pairs), ~np.uint64(0)) for _ in range(size)]
    down = [np.zeros(len(pairs), dtype=np.uint64) for _ in range(size)]
    edits, best, ends = lengths.copy(), lengths.copy(), np.zeros(len(pairs), dtype=np.int64)
    for j, here in enumerate(texts, 1):
        more = less = np.uint64(0)
        for w in range(size):
            match, u, d = masks[w].take(here), up[w], down[w]
            either = match | d
            match = match | less
            diagonal = (((match & u) + u) ^ u) | match
            plus, minus = d | ~(diagonal | u), u & diagonal
            shift = np.uint64(63) if w < size - 1 else top
            out_more, out_less = (plus >> shift) & one, (minus >> shift) & one
            plus, minus = (plus << one) | more, (minus << one) | less
            up[w], down[w] = minus | ~(either | plus), plus & either
            more, less = out_more, out_less
        edits += more.astype(np.int64) - less.astype(np.int64)
        better = edits < best
        best[better], ends[better] = edits[better], j
    return best.tolist(), ends.tolist()


class Index:
    """Windows of items by their keys, for one kind of walk."""

    def __init__(self, items: list[tuple[int, str]], steps: int, samples: int):
        self.walks = walks(steps, samples)
        self.lengths = np.array([len(text) for _, text in items])
        starts = [_word_starts(text) for _, text in items]
        starts = [at[at <= max(0, n - int(0.6 * steps))] for at, n in zip(starts, self.lengths)]
        # the items lie one behind the other, with zeros between them
        sizes = self.lengths + 1
        first = np.cumsum(sizes) - sizes
        characters = np.concatenate([*[_characters(text) for _, text in items], np.zeros(1, dtype=np.uint8)])
        numbers = np.repeat(np.arange(len(items), dtype=np.int32), [len(at) for at in starts])
        offsets = np.concatenate(starts).astype(np.int32)
        self.tables = []
        for walk in self.walks:
            _, keys, ends = walk.keys(characters, offsets + first[numbers], learn=True)
            inside = ends < first[numbers] + self.lengths[numbers]
            keys, at, number = keys[inside], offsets[inside], numbers[inside]
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], at[order], number[order]))

    def places(self, starts: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``starts``, item, and where the item would begin in ``characters``."""
        found = []
        for walk, (keys, offsets, numbers) in zip(self.walks, self.tables):
            windows, own, _ = walk.keys(characters, starts)
            left, right = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
            counts = right - left
            entry = np.repeat(right - np.cumsum(counts), counts) + np.arange(counts.sum())
            window = np.repeat(windows, counts)
            found.append((window, numbers[entry], starts[window] - offsets[entry]))
        return tuple(np.concatenate(parts) for parts in zip(*found))


class Detector:
    def __init__(self, items: list[tuple[int, str]], max_edits: float):
        self.max_edits = max_edits
        normal = sorted({(i, _normal(text)) for i, text in items if text is not None})
        self.groups = []
        above = float("inf")
        for least, steps, samples in WALKS:
            mine = [(i, text) for i, text in normal if least <= len(text) < above]
            above = least
            if mine:
                self.groups.append((mine, Index(mine, steps, samples)))

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (item, start, edits) of the items in it, starts in the normalised text.

        The windows of all texts walk together; the texts lie one behind the other, with a zero between them.
        """
        normal = list(map(_normal, texts))
        sizes = np.fromiter((len(t) + 1 for t in normal), dtype=np.int64, count=len(normal))
        first = np.cumsum(sizes) - sizes
        characters = np.concatenate([*map(_characters, normal), np.zeros(1, dtype=np.uint8)])
        starts = [_word_starts(t) for t in normal]
        owner = np.repeat(np.arange(len(texts)), [len(at) for at in starts])
        starts = np.concatenate([*starts, np.empty(0, dtype=np.int64)]).astype(np.int64) + first[owner]
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for items, index in self.groups:
            window, number, place = index.places(starts, characters)
            places = np.unique(np.stack([owner[window], number, place - first[owner[window]]]), axis=1)
            self._verify(normal, places.T.tolist(), items, best)
        return [[(item, start, edits) for item, (edits, start) in sorted(b.items())] for b in best]

    def _verify(self, texts: list[str], places: list[list[int]], items: list[tuple[int, str]], best: list[dict[int, tuple[int, int]]]) -> None:
        """``places`` (text, item, where it would begin) are sorted."""
        found, open_ = [], []
        done = None
        for k, number, place in places:
            item = items[number][1]
            most = int(self.max_edits * len(item))
            # one alignment covers all places that are off by less than the edits it allows
            if done is not None and done[:2] == (k, number) and place - done[2] <= most // 2:
                continue
            done = k, number, place
            off = most + most // 2
            low, high = max(0, place - off), max(0, place + len(item) + off)
            exact = texts[k].find(item, low, high)
            if exact >= 0:
                found.append((k, number, 0, exact))
            elif low < len(texts[k]):
                open_.append((k, number, low, high))
        aligned = best_matches([(items[number][1], texts[k][low:high]) for k, number, low, high in open_])
        for (k, number, low, _), (edits, end) in zip(open_, aligned):
            found.append((k, number, edits, max(0, low + end - len(items[number][1]))))
        for k, number, edits, start in found:
            item_id, item = items[number]
            if edits <= int(self.max_edits * len(item)):
                best[k][item_id] = min(best[k].get(item_id, (edits, start)), (edits, start))


def _in_parts(detect: Detector, texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    part = np.cumsum([len(t) for t in texts]) // PART_CHARS
    for _, some in groupby(zip(part.tolist(), texts), key=itemgetter(0)):
        yield from detect.leaks([t for _, t in some])


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    for block in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """A row for each document and item in it: ``doc_id``, ``item_id``, ``start`` (in the normalised text), ``edits``."""
    bound_batches(docs.sparkSession)
    texts = exact_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    result = None
    for items in blocks(benchmark):

        def found(batches: Iterator[pd.DataFrame], items: list[tuple[int, str]] = items) -> Iterator[pd.DataFrame]:
            detect = Detector(items, max_edits)
            for batch in batches:
                rows = [
                    (doc_id, *leak)
                    for doc_id, leaked in zip(batch["doc_id"], _in_parts(detect, batch["text"].tolist()))
                    for leak in leaked
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "edits"])

        rows = texts.mapInPandas(found, "doc_id STRING, item_id BIGINT, start BIGINT, edits BIGINT")
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
        result = rows if result is None else result.unionByName(rows)
    return result


def contaminated(items: list[tuple[int, str]], max_edits: float = MAX_EDITS):
    """A column function: whether a text has an item in it."""

    @F.pandas_udf(BooleanType())
    def has_leak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = Detector(items, max_edits)
        for texts in batches:
            yield pd.Series([bool(leaked) for leaked in _in_parts(detect, texts.tolist())], dtype=bool)

    return has_leak


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The documents without any item, with their columns unchanged."""
    bound_batches(docs.sparkSession)
    for items in blocks(benchmark):
        docs = docs.where(~contaminated(items, max_edits)(text_of()))
    return docs
