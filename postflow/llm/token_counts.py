"""Token counts by a compiled finite-state transducer.

A BPE vocabulary (pieces with scores: of two neighbours whose concatenation is a piece, the pair with the best score
merges first, the leftmost of equals) is compiled to a deterministic transducer that reads characters and emits, with
every transition, by how many tokens the encoding grew. Emissions can be negative: ``in`` + ``g`` is one token again.

**States.** The last token of a prefix decides how the encoding goes on. Let ``last(j)`` be the last token of the first
j characters. After one more character it is the only piece t that ends there and fits behind ``last(j)`` at its own
start j, where t fits behind u if the text ``ut`` is encoded as u, t. All that can still matter lies within the longest
suffix that some piece starts with; a state is that suffix with the last token and the relative count at each of its
positions. That is a finite set. It is built on demand, and dropped and built anew beyond ``MAX_STATES``.

**Resets.** Where two neighbouring characters stand together in no piece, nothing can join them, so the machine is in
its start state in front of the second one. Words begin at such places, and the emissions of a word, from start state to
start state, are kept as one composite transition.

**Chunks.** A long text is read in chunks. The map of a chunk sends an entry state to an exit state and a count. Up to
the chunk's first reset it depends on the entry state, behind it not, so a map is a head to be read from the entry
state, a count and an exit state. Maps compose associatively; those of a text are composed by a balanced scan.

Texts never move: a document is one row and its count one narrow pass. Memory holds one Arrow batch, the machine and
``MAX_WORDS`` composite transitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from postflow.llm.common import bound_batches, text_of

#: Stands for a space in pieces.
SPACE = "▁"
CHUNK = 1 << 14
MAX_STATES = 300_000
MAX_WORDS = 600_000
#: Longer words are read character by character and not kept.
WORD_LENGTH = 40


class Vocabulary(NamedTuple):
    """Pieces with their scores. ``prefix`` is put in front of a text that isn't empty."""

    scores: dict[str, float]
    prefix: str = SPACE


def load_sentencepiece(path: str) -> Vocabulary:
    """The vocabulary of a BPE model with byte fallback, spaces kept and no other normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_byte, model.is_unused, model.is_unknown)
    ids = [i for i in range(model.get_piece_size()) if not any(kind(i) for kind in special)]
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in ids})


class ChunkMap(NamedTuple):
    """What a chunk does to an entry state: read ``head``; then, if the chunk has a reset, ``count`` more to ``exit``."""

    head: str
    count: int | None
    exit: int | None


class Spines(NamedTuple):
    """Of a piece: the tokens at its left and right end while it is encoded, with the score that made each; whether it
    ends as one token; whether its merges went from better to worse scores."""

    left: list[tuple[str, float]]
    right: list[tuple[str, float]]
    whole: bool
    ordered: bool


class Transducer:
    START = 0

    def __init__(self, vocabulary: Vocabulary):
        self.scores, self.prefix = vocabulary
        pieces = self.scores
        self.starts = {p[:k] for p in pieces for k in range(1, len(p))}
        self.inner = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.follows: dict[tuple[str | None, str], bool] = {}
        self.known_spines: dict[str, Spines] = {}
        # words start in front of a space behind another character, if no piece has that inside
        split = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inner)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if split else None
        self._clear()

    def _clear(self) -> None:
        """A state is (suffix, last token and relative count at each of its positions)."""
        self.keys: list[tuple[str, tuple[tuple[str | None, int], ...]]] = [("", ((None, 0),))]
        self.ids = {self.keys[0]: self.START}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.counts: dict[str, int] = {}

    def encode(self, text: str) -> list[str]:
        """The pieces of a short text by merging, as the definition says."""
        parts = list(text)
        while True:
            best = max(
                ((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None
            )
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def spines(self, piece: str) -> Spines:
        """How the ends of a piece come about when it is encoded by itself."""
        found = self.known_spines.get(piece)
        if found is None:
            parts, left, right, scores = list(piece), [], [], []
            left.append((parts[0], 0.0))
            right.append((parts[-1], 0.0))
            while True:
                pairs = ((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores)
                score, i = max(pairs, default=(0.0, 1))
                if i == 1:
                    break
                parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
                scores.append(score)
                if i == 0:
                    left.append((parts[0], score))
                if -i == len(parts) - 1:
                    right.append((parts[-1], score))
            ordered = all(a > b for a, b in zip(scores, scores[1:]))
            found = self.known_spines[piece] = Spines(left, right, len(parts) == 1, ordered)
        return found

    def fits(self, before: str | None, piece: str) -> bool:
        """Whether ``before + piece`` is encoded as the two. Both are encoded as themselves.

        Where the merges inside both go from better to worse scores, only the tokens at their common border matter:
        they must not merge before one of them is taken in by its own piece.
        """
        key = before, piece
        if key in self.follows:
            return self.follows[key]
        right = self.spines(piece)
        if before is None or not right.whole:
            fit = right.whole
        else:
            left = self.spines(before)
            if not (left.ordered and right.ordered):
                fit = self.encode(before + piece) == [before, piece]
            else:
                fit = self._apart(left.right, right.left)
        self.follows[key] = fit
        return fit

    def _apart(self, ends: list[tuple[str, float]], beginnings: list[tuple[str, float]]) -> bool:
        i = j = 0
        never = float("-inf")
        while True:
            joined = self.scores.get(ends[i][0] + beginnings[j][0])
            next_end = ends[i + 1][1] if i + 1 < len(ends) else never
            next_beginning = beginnings[j + 1][1] if j + 1 < len(beginnings) else never
            if joined is not None and joined > next_end and joined >= next_beginning:
                return False
            if next_end == never and next_beginning == never:
                return True
            if next_end >= next_beginning:
                i += 1
            else:
                j += 1

    def _step(self, state: int, char: str) -> tuple[int, int]:
        """The transition from ``state``, compiled when it is first needed."""
        suffix, history = self.keys[state]
        if char not in self.scores:  # bytes stand for it, and nothing joins them
            found = self.START, len(char.encode())
        else:
            text = suffix + char
            if suffix and text[-2:] not in self.inner:
                text, history = char, ((None, history[-1][1]),)
            for k in range(len(text)):
                piece, (before, count) = text[k:], history[k]
                if piece in self.scores and self.fits(before, piece):
                    break
            emitted = count + 1
            history = (*((t, n - emitted) for t, n in history), (piece, 0))
            cut = next((k for k in range(len(text)) if text[k:] in self.starts), len(text))
            key = (text[cut:], history[cut:]) if cut < len(text) else self.keys[self.START]
            if key not in self.ids:
                self.ids[key] = len(self.keys)
                self.keys.append(key)
                self.steps.append({})
            found = self.ids[key], emitted
        self.steps[state][char] = found
        return found

    def walk(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and emitted tokens."""
        steps, total = self.steps, 0
        for char in text:
            state, emitted = steps[state].get(char) or self._step(state, char)
            total += emitted
        return state, total

    def word(self, word: str) -> int:
        """The composite transition of a word, from start state to start state."""
        count = self.counts.get(word)
        if count is None:
            count = self.walk(self.START, word)[1]
            if len(word) <= WORD_LENGTH:
                self.counts[word] = count
        return count

    def chunk_map(self, text: str) -> ChunkMap:
        """The map of a chunk of normalised text."""
        reset = next((k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.inner), None)
        if reset is None:
            return ChunkMap(text, None, None)
        head, rest = text[:reset], text[reset:]
        if self.words is None:
            state, count = self.walk(self.START, rest)
            return ChunkMap(head, count, state)
        *words, last = self.words.findall(rest)
        known, count = self.counts, 0
        for word in words:
            n = known.get(word)
            count += self.word(word) if n is None else n
        state, n = self.walk(self.START, last)
        return ChunkMap(head, count + n, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if a.count is None:
            return ChunkMap(a.head + b.head, b.count, b.exit)
        # a head can begin with a reset against what stands before; walking it from the exit state finds that
        state, n = self.walk(a.exit, b.head)
        if b.count is None:
            return ChunkMap(a.head, a.count + n, state)
        return ChunkMap(a.head, a.count + n + b.count, b.exit)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, neighbours first: as many rounds as the logarithm of their number."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[2 * len(pairs) :]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(self.keys) > MAX_STATES:
            self._clear()
        if len(self.counts) > MAX_WORDS:
            self.counts = {}
        if len(self.follows) > 4 * MAX_STATES:
            self.follows = {}
        text = (self.prefix + text).replace(" ", SPACE)
        whole = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.walk(self.START, whole.head)[1] + (whole.count or 0)


_kept: dict[bytes, Transducer] = {}


def compiled(vocabulary: Vocabulary) -> Transducer:
    """The transducer of a vocabulary; a worker process keeps the last one for its next tasks."""
    key = blake2b(repr((vocabulary.prefix, sorted(vocabulary.scores.items()))).encode()).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Transducer(vocabulary)
    return _kept[key]


def counter(vocabulary: Vocabulary, chunk: int = CHUNK):
    """A column function: the tokens of a text column. The vocabulary is the only thing that is sent to the tasks."""

    @F.pandas_udf(LongType())
    def token_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transducer = compiled(vocabulary)
        for texts in batches:
            yield pd.Series([transducer.count(text, chunk) for text in texts], dtype="int64")

    return token_count


def with_token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int = 4096, text: str | Column = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``).

    **Defined cases.** A null text counts as empty: no bytes, no tokens. Every row is counted by itself, so repeated
    rows and ids stay as they are. Columns of the input named like one of the three are replaced; all others stay. An
    empty table gives an empty table. Texts are read whole, whatever their length.
    """
    bound_batches(docs.sparkSession)
    body = text_of(text) if isinstance(text, str) else text
    named = {"n_bytes", "n_tokens", "over_limit", text if isinstance(text, str) else ""}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    counted = docs.select(*kept, F.octet_length(body).cast("long").alias("n_bytes"), counter(vocabulary)(body).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
