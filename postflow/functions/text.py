"""Text normalisation and tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postflow import constants as K

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def strip_retweet(text: Column) -> Column:
    return F.regexp_replace(text, K.RETWEET_PREFIX_PATTERN, "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, K.URL_PATTERN, "")


def unescape_html(text: Column) -> Column:
    """One pass in the given order: ``&amp;lt;`` becomes ``&lt;``, not ``<``."""
    for entity, char in K.HTML_UNESCAPES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def collapse_space(text: Column) -> Column:
    """White space runs become one blank; only the end is trimmed."""
    # the first class rules out ordinary letters in one step, which makes the scan several times faster
    pattern = rf"[[\x00-\x20\x{{0080}}-\x{{FFFF}}]&&{K.WHITESPACE_PATTERN.rstrip('+')}]+"
    return F.rtrim(F.regexp_replace(text, pattern, " "))


def by_patterns(text: Column) -> Column:
    """The normalisation, step by step."""
    return collapse_space(unescape_html(strip_urls(strip_retweet(text))))


def is_plain(text: Column) -> Column:
    """Whether nothing but blanks and line feeds can change; looking for characters is many times faster than patterns."""
    none_of = lambda parts: reduce(and_, [~F.contains(text, F.lit(part)) for part in parts])
    ascii_only = F.octet_length(text) == F.char_length(text)
    return ~F.startswith(text, F.lit("RT ")) & none_of(("&", "http", *K.ASCII_BLANKS)) & (ascii_only | none_of(K.OTHER_BLANKS))


def normalize_text(text: Column) -> Column:
    """Without the retweet prefix and URLs, with entities as characters and runs of white space as one blank.

    ``text`` should be a column of its own: it is looked at several times.
    """
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    plain = F.when(F.contains(lines, F.lit("  ")), F.regexp_replace(lines, "  +", " ")).otherwise(lines)
    return F.when(is_plain(text), F.rtrim(plain)).otherwise(by_patterns(text))


def content_key(normalized: Column) -> Column:
    """Cache key of a normalised text."""
    return F.sha2(normalized, 256)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, so that one emoji counts two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


# --- tokens --------------------------------------------------------------------------------

_FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF_KANA = "".join(map(chr, range(0xFF65, 0xFF9E)))
_SOUND_MARKS = {"ﾞ": "゙", "ﾟ": "゚"}


def fold_width(text: Column) -> Column:
    """Full-width ASCII to ASCII, half-width katakana to katakana (the compatibility forms of Unicode)."""
    narrow = _FULL_WIDTH + _HALF_KANA
    # most texts have none of these characters, and looking is cheaper than translating
    affected = (F.octet_length(text) != F.char_length(text)) & text.rlike(r"[\x{FF01}-\x{FF9F}]")
    folded = F.translate(text, narrow, "".join(unicodedata.normalize("NFKC", c) for c in narrow))
    voiced = folded
    for kana in map(chr, range(0x30A1, 0x30FB)):
        for mark, combining in _SOUND_MARKS.items():
            composed = unicodedata.normalize("NFC", kana + combining)
            if len(composed) == 1:
                voiced = F.replace(voiced, F.lit(kana + mark), F.lit(composed))
    return F.when(~affected, text).when(text.rlike("[ﾞﾟ]"), voiced).otherwise(folded)


def _alternation(terms: Iterable[str]) -> str | None:
    """Pattern of the terms that splitting would break; longest first, so that the leftmost match is the longest."""
    parts = []
    for term in sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t)):
        if re.fullmatch(r"[a-z0-9_]+", term):
            continue  # a word by itself anyway
        escaped = re.escape(term)
        if term.isascii():
            escaped = rf"(?<![\p{{L}}\p{{N}}_]){escaped}(?![\p{{L}}\p{{N}}_])"
        parts.append(escaped)
    return "|".join(parts) or None


def tokens(
    text: Column,
    dictionary: Iterable[str] = (),
    stop_words: Iterable[str] = (),
    fold: bool = True,
) -> Column:
    """Lower-cased terms of the whole text, in order of kind: dictionary terms first, then words.

    ``dictionary`` terms (also with blanks or dots, also inside text written without blanks) stay whole;
    what is left is split at everything but letters, digits and ``_``.
    """
    folded = F.lower(fold_width(text) if fold else text)
    stops = sorted(set(stop_words))
    terms = _alternation(dictionary)
    rest = F.regexp_replace(folded, terms, " ") if terms else folded
    words = F.filter(
        F.split(rest, WORD_BREAK),
        lambda w: (w != "") & ~w.isin(stops) if stops else (w != ""),
    )
    if terms is None:
        return words
    return F.concat(F.regexp_extract_all(folded, F.lit(f"({terms})"), F.lit(1)), words)
