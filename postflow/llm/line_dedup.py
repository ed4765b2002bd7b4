"""Lines that occur before in the corpus, also with a few edits, removed: a segment-partition edit join.

**Classes.** Lines with a word are compared, without the white space around them. Equal lines are one class, and so are
lines of ``EDIT_LENGTH`` characters or more that are linked by pairs of at most ``edits`` edits: in a shorter line one
edit is more than a thirtieth of it and often another meaning. The first line of a class stays; the order is by document
id, then by position.

**Join.** A line of ``EDIT_LENGTH`` characters or more is cut into ``edits + 1`` segments of even length. Of two lines at
most ``edits`` apart, one segment of the shorter is found whole in the longer, shifted by no more than the edits around
it allow. So a line is indexed by its length, a segment's number and the segment, and it is probed, for each length that
a partner may have, with its substrings at the places that the number and the difference of lengths leave open. Equal
keys with different lines are the candidates, and most keys belong to one line only: they are found by a combined minimum
and maximum, and only the others are joined. Candidates are verified by a banded bit-parallel edit distance.

**Distribution.** All of it is column expressions. What is shuffled for the join are hashes; a line of a third of all
documents is one row per document there, with combined minima. The texts are shuffled once, to meet what is removed.

**Defined cases.** A null text stays null and has no lines. Lines of white space stay and are not compared. Rows with
equal ids are one document: they are not compared with each other, and null ids are one document behind all others.
Columns other than ``text`` stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import SPACE_CHARS, aside, small, written
from postflow.llm.components import components

#: Lines from here on are joined by edits.
EDIT_LENGTH = 30
#: Edits between lines of a class. A band of 2 * edits + 1 bits must fit into a long.
EDITS = 1
#: Parts of the half that has the edit.
PARTS = 8
#: Characters that are compared at once at the ends of candidates.
PART = 16

_LAST = 2**63 - 1


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("int")


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th segment (from 0) of a line; the last segments are the longer ones."""
    n = edits + 1
    short, longer = _div(length, n), F.pmod(length, F.lit(n))
    before = F.greatest(F.lit(i) - (F.lit(n) - longer), F.lit(0))
    return F.lit(i) * short + before + 1, short + (F.lit(i) >= F.lit(n) - longer).cast("int")


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start, size))


def _places(length: Column, edits: int) -> Iterator[tuple[int, Column, Column, Column, Column]]:
    """Where a line is indexed and probed: the segment's number, the length of the line it belongs to, its start in this
    line and its length, and whether there is a place for it."""
    for less in range(edits + 1):
        other = length - less
        for i in range(edits + 1):
            start, size = segment(other, i, edits)
            # what stands in front of the segment has at most i edits, what stands behind it at most edits - i
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                fits = (start + shift >= 1) & (start + shift + size - 1 <= length) & (other >= EDIT_LENGTH)
                yield i, other, start + shift, size, fits


def keys_of(line: Column, length: Column, edits: int) -> Column:
    """The keys of a line: those of its own segments, and its probes of shorter lines and shifted segments; null where
    there is no place for one."""
    return F.array(*[F.when(fits, _key(line, other, i, start, size)) for i, other, start, size, fits in _places(length, edits)])


def fine_keys_of(line: Column, length: Column) -> Column:
    """For one edit: with each key of a line the keys ``fine`` that two lines share which differ in one part only.

    One half is equal, so the edit is in the other. That is cut into ``PARTS``; what stands in front of the part with the
    edit is equal, and so is what stands behind it, counted from the end.
    """
    keys = []
    for i, other, start, size, fits in _places(length, 1):
        key = _key(line, other, i, start, size)
        rest = F.substring(line, start + size, length) if i == 0 else F.substring(line, F.lit(1), start - 1)
        n = other - size
        cut = lambda j, n=n: F.floor(n * j / F.lit(PARTS)).cast("int")
        fine = []
        for j in range(PARTS):
            behind = n - cut(j + 1)
            end = F.when(behind > 0, F.substring(rest, F.char_length(rest) - behind + 1, behind)).otherwise("")
            fine.append(F.xxhash64(key, F.lit(j), F.substring(rest, F.lit(1), cut(j)), end))
        keys.append(F.when(fits, F.struct(key.alias("key"), F.array(*fine).alias("fine"))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def distance(a: str, b: str, edits: int) -> Column:
    """The edit distance of the lines in columns ``a`` and ``b`` if it is at most ``edits``, else some larger number.

    A column of the distance matrix is kept as bits along a band of 2 * edits + 1 diagonals: bit r of column j is row
    j - edits + r. One word holds where the distance rises down the column, one where it falls; with the next character
    both move by a bit, as the band does. The result is followed along the diagonal in which the matrix ends.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    chars = lambda c: F.when(F.char_length(c) > 0, F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(F.col(c), i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    m, n = F.char_length(a), F.char_length(b)
    ends = m - n + edits  # the diagonal of the last cell

    def column(cells: Column, j: Column) -> Column:
        # j from 1; the band's rows are j - edits .. j + edits
        here = F.get(cells["b"], j - 1)
        equal = F.lit(0).cast("long")
        for r in range(band):
            row = F.get(cells["a"], j - edits + r - 1)
            equal = equal + F.when(row == here, F.lit(1 << r).cast("long")).otherwise(0)
        rises, falls = cells["rises"], cells["falls"]
        rises = F.shiftright(rises, 1).bitwiseOR(F.lit(1 << (band - 1)).cast("long"))
        falls = F.shiftright(falls, 1)
        stays = ((equal.bitwiseAND(rises) + rises).bitwiseXOR(rises)).bitwiseOR(equal).bitwiseOR(falls).bitwiseAND(F.lit(full).cast("long"))
        return F.struct(cells["a"].alias("a"), cells["b"].alias("b"), rises.alias("rises"), falls.alias("falls"), stays.alias("stays"), cells["edits"].alias("edits"))

    def after(cells: Column, j: Column) -> Column:
        rises, falls, stays = cells["rises"], cells["falls"], cells["stays"]
        up = falls.bitwiseOR(F.lit(full).cast("long") - stays.bitwiseOR(rises))
        down = stays.bitwiseAND(rises)
        up = (F.shiftleft(up, 1).bitwiseOR(F.lit(1).cast("long"))).bitwiseAND(F.lit(full).cast("long"))
        down = F.shiftleft(down, 1).bitwiseAND(F.lit(full).cast("long"))
        new_rises = down.bitwiseOR(F.lit(full).cast("long") - stays.bitwiseOR(up))
        new_falls = up.bitwiseAND(stays)
        apart = F.when(F.getbit(stays, F.least(F.greatest(cells["ends"], F.lit(0)), F.lit(band - 1))) == 1, 0).otherwise(1)
        counted = cells["edits"] + F.when(j > cells["from"], apart).otherwise(0)
        return F.struct(cells["a"].alias("a"), cells["b"].alias("b"), new_rises.alias("rises"), new_falls.alias("falls"), cells["ends"].alias("ends"), cells["from"].alias("from"), counted.alias("edits"))

    def step(cells: Column, j: Column) -> Column:
        first = column(cells, j)
        # evaluated once: a one-element array carries the intermediate column into the second half
        whole = F.transform(F.array(first), lambda c: after(F.struct(c["a"].alias("a"), c["b"].alias("b"), c["rises"].alias("rises"), c["falls"].alias("falls"), c["stays"].alias("stays"), c["edits"].alias("edits"), cells["ends"].alias("ends"), cells["from"].alias("from")), j))
        return F.get(whole, F.lit(0))

    # column 0: row i has the distance |i|
    start = F.struct(
        chars(a).alias("a"), chars(b).alias("b"),
        F.lit(full & ~((1 << (edits + 1)) - 1)).cast("long").alias("rises"), F.lit((1 << (edits + 1)) - 1).cast("long").alias("falls"),
        ends.alias("ends"), F.greatest(n - m, F.lit(0)).alias("from"), F.abs(m - n).alias("edits"),
    )
    walked = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step, lambda c: c["edits"])
    return F.when(F.abs(m - n) <= edits, walked).otherwise(edits + 1)


def _equal_parts(a: str, b: str, reverse: bool) -> Column:
    """How many characters, in whole parts of ``PART``, two lines have in common at one end."""
    one, two = (F.reverse(a), F.reverse(b)) if reverse else (F.col(a), F.col(b))
    parts = F.floor(F.least(F.char_length(a), F.char_length(b)) / PART).cast("int")
    differ = lambda i: F.substring(one, i * PART + 1, F.lit(PART)) != F.substring(two, i * PART + 1, F.lit(PART))
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))), differ), F.lit(True))
    return PART * F.when(parts == 0, 0).when(first == 0, parts).otherwise(first.cast("int") - 1)


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs of lines ``a``, ``b`` with at most ``edits`` edits.

    Equal beginnings and endings are cut off first, which leaves the distance as it is. One edit leaves less than three
    parts, so with one edit allowed longer rests need no distance. What is left of the lines, and then the distance, are
    written before they are used: Spark would put their expressions into each other, and into the filter, and compute
    them once for every place in which they are named.
    """
    names = [c for c in pairs.columns if c not in ("a", "b")]
    step = pairs.select(*names, "a", "b", _equal_parts("a", "b", False).alias("_front"))
    rest = lambda c: F.substring(F.col(c), F.col("_front") + 1, F.char_length(c))
    step = step.select(*names, rest("a").alias("a"), rest("b").alias("b"))
    step = step.select(*names, "a", "b", _equal_parts("a", "b", True).alias("_back"))
    rest = lambda c: F.substring(F.col(c), F.lit(1), F.char_length(c) - F.col("_back"))
    step = step.select(*names, rest("a").alias("a"), rest("b").alias("b"))
    step = written(step, "line-rests")
    if edits == 1:
        step = step.where(F.greatest(F.char_length("a"), F.char_length("b")) < 3 * PART)
    judged = written(step.select(*names, distance("a", "b", edits).alias("distance")), "line-distances")
    return judged.where(F.col("distance") <= edits).select(*names)


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def line_table(docs: DataFrame, edits: int) -> DataFrame:
    """The distinct lines of each document: ``doc``, two hashes ``h`` and ``g``, the position ``at``, the keys."""
    lines = docs.select(_order(F.col("doc_id")).alias("doc"), F.posexplode(lines_of(F.col("text"))).alias("at", "raw"))
    lines = lines.select("doc", "at", trimmed(F.col("raw")).alias("line"))
    lines = lines.select("doc", "at", "line", F.char_length("line").alias("length")).where(F.col("length") > 0)
    keys = keys_of(F.col("line"), F.col("length"), edits)
    return lines.select("doc", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"), keys.alias("keys"))


def candidates(lines: DataFrame) -> DataFrame:
    """Lines that have a key in common with another line: ``key``, ``h``, ``g``."""
    keyed = lines.select(F.explode("keys").alias("key"), "h", "g").where("key IS NOT NULL")
    shared = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    return written(keyed.join(small(written(shared, "shared-keys")), "key").distinct(), "shared-lines")


def paired(some: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs of the lines that :func:`candidates` found: (h, g, h2, g2), the smaller first.

    Many lines can share a half, and few of them are near each other. So with one edit lines meet by their fine keys.
    """
    if edits == 1:
        fine = texts.select("h", "g", F.explode(fine_keys_of(F.col("line"), F.char_length("line"))).alias("k"))
        fine = some.join(fine.select("h", "g", "k.key", "k.fine"), ["key", "h", "g"]).select(F.explode("fine").alias("key"), "h", "g")
        fine = written(fine.distinct(), "fine-keys")
        shared = fine.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
        some = fine.join(shared, "key", "left_semi")
    other = some.select("key", F.col("h").alias("h2"), F.col("g").alias("g2"))
    return some.join(other, "key").where("h < h2").select("h", "g", "h2", "g2").distinct()


def near_lines(docs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Classes of different lines with few edits between them: ``h``, ``g``, ``class``."""
    some = candidates(lines)
    ends = written(some.select("h", "g").distinct(), "line-pair-ends")
    wanted = small(ends)
    texts = docs.select(F.explode(lines_of(F.col("text"))).alias("raw")).select(trimmed(F.col("raw")).alias("line"))
    texts = texts.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"), "line")
    texts = written(texts.join(wanted, ["h", "g"]).distinct(), "line-texts")
    pairs = written(paired(some, texts, edits), "line-pairs")
    both = pairs.join(texts.withColumnRenamed("line", "a"), ["h", "g"])
    both = both.join(texts.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("line").alias("b")), ["h2", "g2"])
    name = lambda h, g: F.concat(F.hex(h), F.lit("-"), F.hex(g))
    links = within(both, edits).select(name("h", "g").alias("a"), name("h2", "g2").alias("b"))
    classes = components(links)
    named = ends.withColumn("node", name("h", "g"))
    return named.join(classes, "node").select("h", "g", F.col("component").alias("class"))


def removals(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """For each document the hashes of lines that don't stay: ``doc``, ``removed``."""
    lines = written(line_table(docs, edits), "lines")
    near = written(near_lines(docs, lines, edits), "near-lines")
    firsts = lines.groupBy("h", "g").agg(F.min("doc").alias("first"))
    # equal lines: all but those of the first document; within a document the position decides later
    repeated = lines.join(firsts, ["h", "g"]).where("doc > first").select("doc", "h")
    # near lines: there are few of them
    placed = lines.join(small(near), ["h", "g"]).groupBy("class", "doc", "h").agg(F.min("at").alias("at"))
    first = placed.groupBy("class").agg(F.min(F.struct("doc", "at")).alias("first"))
    later = placed.join(first, "class").where(F.struct("doc", "at") > F.col("first")).select("doc", "h")
    return repeated.unionByName(later).groupBy("doc").agg(F.collect_set("h").alias("removed"))


def dedup(docs: DataFrame, edits: int = EDITS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` without removed lines, and the numbers of its lines and of those removed, named ``counts``
    (columns of these names are replaced)."""
    docs, named = aside(docs, "doc_id", "text")
    gone = removals(docs, edits).select(F.col("doc").alias("_doc"), F.col("removed").alias("_removed"))
    joined = docs.withColumn("_order", _order(F.col("doc_id"))).join(gone, F.col("_order") == F.col("_doc"), "left")
    step = joined.withColumn("_lines", lines_of(F.col("text"))).withColumn("_hashes", F.transform("_lines", lambda line: F.xxhash64(trimmed(line))))

    def stays(line: Column, i: Column) -> Column:
        h = F.get(F.col("_hashes"), i)
        words = F.char_length(trimmed(line)) > 0
        again = F.array_position("_hashes", h) <= i
        return ~words | ~(F.coalesce(F.array_contains("_removed", h), F.lit(False)) | again)

    step = step.withColumn("_kept", F.filter("_lines", stays))
    text = F.when(F.size("_kept") < F.size("_lines"), F.array_join("_kept", "\n")).otherwise(F.col("text"))
    n = F.when(F.octet_length("text") > 0, F.size("_lines")).otherwise(0)
    return step.select(
        *[text.alias("text") if c == "text" else column for c, column in named.items() if c not in counts],
        F.coalesce(n, F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias(counts[1]),
    )
