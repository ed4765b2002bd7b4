"""Hierarchical packing of token sequences into windows of several lengths.

The tiers are the longest window and a few halvings of it; all are powers of two, so a full window of any tier needs no
padding. A document gives whole longest windows, and its remainder is routed to the shortest tier that holds it. Tier by
tier, longest first, a window takes the longest remainder waiting there; its gap is filled from the shorter tiers, with
the longest piece that fits, and where none fits with the beginning of one. So every window that is closed is full.

Level 1 packs blocks of documents in one pass over the texts, without a shuffle. Less than one longest window of a block
can be left over. Level 2 packs these leftovers for many blocks together and closes the rest in shorter windows; one
window of each such group is padded. Only leftovers are shuffled, a small part of the tokens in any case.

**Step groups.** The windows of a block are dealt to groups of about ``STEP_TOKENS`` tokens, long ones first and in
turn, so its groups differ by one window at most.

**Lost executors.** The rows of level 1 are written before level 2 reads them. A repeated task reads the same rows in
the same order and gives the same windows, as long as its input is a table.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import bound_batches, exact_id, longs, text_of, written

#: Window lengths, longest first.
TIERS = (4096, 2048, 1024, 512)
#: Tokens of a block; with its ids this bounds a task's memory.
BLOCK_TOKENS = 1 << 21
#: Leftovers of so many partitions, and of so many blocks of each, are packed together.
FAN_IN = 32
STEP_TOKENS = 1 << 16
#: Numbers of windows within a block, and of blocks within a partition.
WINDOW_BITS, BLOCK_BITS = 24, 16
#: Words whose ids an encoder keeps, twice: the ones in use and those before them.
MAX_WORDS = 700_000
#: Pieces whose ids an encoder keeps; with more it begins again.
MAX_PIECES = 1_500_000
#: Texts encoded at once.
ENCODED = 64

PIECE = (
    "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, "
    "step_group BIGINT"
)
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]

#: The words of vocabularies whose model sees these, in lower case and apart from each other.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts for which Python's rules give the same: ASCII and the Latin letters that are one character in lower case, too.
_PLAIN = re.compile(r"[\t-\r\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^\sa-z0-9\xDF-\xF6\xF8-\xFF]+")

#: Texts to little-endian 32-bit ids.
Encode = Callable[[list[str]], list[bytes]]


class Piece(NamedTuple):
    """Ids of a document from ``start`` on."""

    doc_id: int | None
    start: int
    data: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.data) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head, rest = self.data[: 4 * length], self.data[4 * length :]
        return self._replace(data=head), self._replace(start=self.start + length, data=rest)


def _length(piece: Piece) -> int:
    return piece.length


class Packer:
    """Packs the pieces of one block. ``waiting`` holds the remainders of each tier by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.full: list[list[Piece]] = []
        self.waiting: dict[int, list[Piece]] = {tier: [] for tier in tiers}
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        self.tokens += piece.length
        while piece.length >= self.tiers[0]:
            window, piece = piece.cut(self.tiers[0])
            self.full.append([window])
        if piece.length:
            self._wait(piece)

    def _wait(self, piece: Piece) -> None:
        tier = min(tier for tier in self.tiers if tier >= piece.length)
        insort(self.waiting[tier], piece, key=_length)

    def _fill(self, tiers: tuple[int, ...], room: int) -> Piece | None:
        """A piece for a gap: the longest that fits, else the beginning of the shortest one."""
        shortest = None
        for tier in tiers:
            pieces = self.waiting[tier]
            if pieces:
                fitting = bisect_right(pieces, room, key=_length)
                if fitting:
                    return pieces.pop(fitting - 1)
                shortest = tier
        if shortest is None:
            return None
        piece, rest = self.waiting[shortest].pop(0).cut(room)
        self._wait(rest)
        return piece

    def pack(self) -> list[Piece]:
        """Closes full windows; returns the pieces that are left, fewer tokens than a longest window."""
        for place, tier in enumerate(self.tiers):
            while self.waiting[tier]:
                window = [self.waiting[tier].pop()]
                room = tier - window[0].length
                while room:
                    piece = self._fill(self.tiers[place + 1 :], room) or self._fill((tier,), room)
                    if piece is None:  # nothing waits in any tier
                        return window
                    window.append(piece)
                    room -= piece.length
                self.full.append(window)
        return []

    def close(self, left: list[Piece]) -> None:
        """Closes what :meth:`pack` has left: full windows of shorter tiers, then one that has to be padded."""
        for tier in self.tiers[1:]:
            while sum(p.length for p in left) >= tier:
                window, room = [], tier
                while room:
                    piece = left.pop(0)
                    if piece.length > room:
                        piece, rest = piece.cut(room)
                        left.insert(0, rest)
                    window.append(piece)
                    room -= piece.length
                self.full.append(window)
        if left:
            self.full.append(left)

    def rows(self, first: int) -> list[tuple]:
        """Rows of the closed windows, numbered from ``first``."""
        sizes = [sum(p.length for p in window) for window in self.full]
        groups = max(1, -(-sum(sizes) // STEP_TOKENS))
        longest_first = sorted(range(len(sizes)), key=lambda k: -sizes[k])
        group = {k: first + turn % groups for turn, k in enumerate(longest_first)}
        found = []
        for k, window in enumerate(self.full):
            offset = 0
            for p in window:
                found.append((p.doc_id, p.start, p.length, zlib.crc32(p.data), p.doc_tokens, first + k, offset, group[k]))
                offset += p.length
        return found


class _PieceIds(dict):
    """The ids of pieces, by the library's model."""

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.tokenize = tokenizer.model.tokenize
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else self.bytes_of(piece)[0][0]
        self[piece] = ids = array("I", [t.id for t in self.tokenize(symbols)]).tobytes()
        return ids


def _has_plain_pieces(model: str) -> bool:
    """Whether the vocabulary cuts texts as :data:`PIECES` says, and nothing else is done with them."""
    told = json.loads(model)
    normalizers = [(n["type"], n.get("pattern"), n.get("content")) for n in (told["normalizer"] or {}).get("normalizers", [])]
    cutters = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    return (
        sys.byteorder == "little"
        and normalizers == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [{k: v for k, v in c.items() if k != "trim_offsets"} for c in cutters] == [split, level]
        and told["model"]["type"] == "BPE"
        and not told["model"]["dropout"]
        and not any(told[k] for k in ("truncation", "padding", "post_processor"))
        and all(t["special"] and not t["normalized"] for t in told["added_tokens"])
    )


@lru_cache(maxsize=1)
def word_encoder(model: str) -> Encode:
    """An encoder for tokenizers that encode words apart from each other; ``model`` is the text of the vocabulary file.

    Words are what spaces and line ends separate; each distinct one is encoded by the library once, many in one call. Texts in which a
    special token could stand are encoded whole. A worker process keeps its encoder for its next tasks.

    Vocabularies that see :data:`PIECES` (letters, digits and signs apart, in lower case) share these between words: of
    texts in plain Latin letters each distinct piece is encoded once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}

    def whole(texts: list[str]) -> list[bytes]:
        encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def apart(words: list[str]) -> list[bytes]:
        """The ids of words, encoded as one text with a special token between them."""
        if not special or not words:
            return whole(words)
        token, mark = next(iter(special.items()))
        (data,) = whole([token.join(words)])
        ends = np.append(np.flatnonzero(np.frombuffer(data, dtype="<u4") == mark), len(data) // 4)
        starts = np.append(0, ends[:-1] + 1)
        return [data[i:j] for i, j in zip((4 * starts).tolist(), (4 * ends).tolist())]

    pieces = _PieceIds(tokenizer) if _has_plain_pieces(model) else None

    def encode(texts: list[str]) -> list[bytes]:
        if pieces is None:
            return by_words(texts)
        if len(pieces) > MAX_PIECES:
            pieces.clear()
        plain = [_PLAIN.fullmatch(text) is not None and not any(token in text for token in special) for text in texts]
        others = iter(by_words([text for text, is_plain in zip(texts, plain) if not is_plain]))
        ids = pieces.__getitem__
        return [b"".join(map(ids, _PLAIN_PIECES.findall(text.lower()))) if is_plain else next(others) for text, is_plain in zip(texts, plain)]

    def by_words(texts: list[str]) -> list[bytes]:
        nonlocal known, before
        if len(known) > MAX_WORDS:  # words that are still in use come back from the older half
            known, before = {}, known
        cut = [None if any(token in text for token in special) else text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*filter(None, cut)).difference(known)
        old = new.intersection(before)
        known.update((word, before[word]) for word in old)
        new = list(new - old)
        for i in range(0, len(new), 4096):
            known.update(zip(new[i : i + 4096], apart(new[i : i + 4096])))
        return [b"".join(map(known.__getitem__, words)) if words else whole([text])[0] for text, words in zip(texts, cut)]

    return encode


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    values = zip(*rows) if rows else [()] * len(columns)
    return pd.DataFrame({name: list(column) if name == "ids" else longs(column) for name, column in zip(columns, values)})


def _pack_blocks(encoder: Callable[[], Encode], tiers: tuple[int, ...], end: int):
    ending = np.array([end], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        block = TaskContext.get().partitionId() << BLOCK_BITS
        packer = Packer(tiers)

        def closed() -> pd.DataFrame:
            left = packer.pack()
            rows = [(*row, block, None) for row in packer.rows(block << WINDOW_BITS)]
            rows += [(p.doc_id, p.start, p.length, None, p.doc_tokens, None, None, None, block, p.data) for p in left]
            return _frame(rows, [*COLUMNS, "block", "ids"])

        for batch in batches:
            texts = batch["text"].tolist()
            encoded = chain.from_iterable(encode(texts[i : i + ENCODED]) for i in range(0, len(texts), ENCODED))
            for doc_id, data in zip(batch["doc_id"], encoded):
                data += ending
                packer.add(Piece(None if pd.isna(doc_id) else int(doc_id), 0, data, len(data) // 4))
                if packer.tokens >= BLOCK_TOKENS:
                    yield closed()
                    packer, block = Packer(tiers), block + 1
        if packer.tokens:
            yield closed()

    return blocks


def _pack_leftovers(tiers: tuple[int, ...]):
    def leftovers(pieces: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(tiers)
        ids = [None if pd.isna(i) else int(i) for i in pieces["doc_id"]]
        rows = list(zip(pieces["block"], ids, pieces["start"], pieces["ids"], pieces["doc_tokens"]))
        for _, doc_id, start, data, tokens in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])):
            packer.add(Piece(doc_id, int(start), bytes(data), int(tokens)))
        packer.close(packer.pack())
        # behind the windows that the first of these blocks has closed itself
        first = (int(pieces["block"].min()) << WINDOW_BITS) + (1 << (WINDOW_BITS - 1))
        return _frame(packer.rows(first), COLUMNS)

    return leftovers


def pack(docs: DataFrame, encoder: Callable[[], Encode], end: int, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    and ``step_group``.

    ``encoder`` makes an :data:`Encode` in a task; every document gets the id ``end`` behind its own. A sequence whose
    length isn't a power of two is to be padded to the longest tier.

    **Defined cases.** A null text counts as empty: a document of the end id alone. A null id stays null. Rows are
    documents of their own, also with equal ids or texts; other columns of the input are not read. An empty table gives
    an empty table. A text is encoded whole; one longer than a block makes a block of its own.
    """
    bound_batches(docs.sparkSession)
    texts = exact_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    packed = texts.mapInPandas(_pack_blocks(encoder, tiers, end), f"{PIECE}, block BIGINT, ids BINARY")
    first = written(packed, "packed-blocks")
    partitions, blocks = F.expr(f"shiftright(block, {BLOCK_BITS})"), F.expr(f"block & {(1 << BLOCK_BITS) - 1}")
    left = exact_id(first.where("ids IS NOT NULL")).groupBy((F.floor(partitions / FAN_IN)).alias("p"), (F.floor(blocks / FAN_IN)).alias("b"))
    second = left.applyInPandas(_pack_leftovers(tiers), PIECE)
    return first.where("ids IS NULL").select(*COLUMNS).unionByName(second)
