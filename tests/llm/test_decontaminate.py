import random

import pytest

from postflow.llm import decontaminate, queries
from postflow.llm.common import read
from postflow.llm.decontaminate import Detector, best_match, normalised


def distance(item, text):
    """Fewest edits between the item and any part of the text, by the full matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        left, row[0], diagonal = i, i, row[0]
        for j, d in enumerate(text, 1):
            left = min(left + 1, row[j] + 1, diagonal + (c != d))
            diagonal, row[j] = row[j], left
    return min(row)


def edited(text, share):
    chars = list(text)
    for _ in range(int(share * len(text))):
        k = random.randrange(len(chars))
        kind = random.random()
        if kind < 0.4:
            chars[k] = random.choice("abcdefgh")
        elif kind < 0.7:
            chars.insert(k, random.choice("abcdefgh "))
        else:
            del chars[k]
    return "".join(chars)


def test_bit_parallel_distance():
    random.seed(1)
    for _ in range(300):
        item = "".join(random.choice("abc ") for _ in range(random.randint(1, 70)))
        text = "".join(random.choice("abc ") for _ in range(random.randint(0, 90)))
        if random.random() < 0.5:
            text += edited(item, 0.1) + text
        match = best_match(item, text, len(item))
        want = distance(item, text)
        assert (match is None and want == len(item)) or match[0] == want or (text == "" and match is None)


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in read(spark, "/root/testdata/sf0.01", "benchmark").collect()]


@pytest.mark.parametrize("share, recall", [(0.0, 1.0), (0.02, 0.99), (0.05, 0.97), (0.08, 0.9)])
def test_recall_of_edited_items(spark, items, share, recall):
    random.seed(2)
    prose = [r.text for r in read(spark, "/root/testdata/sf0.01", "documents").limit(60).collect()]
    detect = Detector(items, 0.2)
    found = total = 0
    for item_id, text in items * 3:
        around = random.choice(prose)
        cut = random.randrange(len(around))
        doc = around[:cut] + "\n" + edited(text, share).upper() + "\n" + around[cut:]
        total += 1
        found += item_id in [leak[0] for leak in detect.leaks([doc])[0]]
    assert found / total >= recall


def test_short_items_and_clean_texts():
    detect = Detector([(1, "a short question of words?"), (2, "tiny"), (3, None), (4, "")], 0.2)
    texts = ["He asked: A SHORT, question of words! Again: tiny", "a short answer with other words in it", "", "a short question"]
    assert detect.leaks(texts) == [[(1, 9, 0)], [], [], []]
    assert detect.leaks(["a short question of", "words"]) == [[], []]
    assert detect.leaks([]) == []


def test_whole_table_against_all_parts(spark, items):
    """Documents whose text has an item in it are found; the edits of what is found are right."""
    docs = {r.doc_id: normalised(r.text)[1] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = queries.op1_decontaminate(spark, "/root/testdata/sf0.01").collect()
    normal = {i: normalised(t)[1] for i, t in items}
    exact = {(d, i) for d, text in docs.items() for i, item in normal.items() if item in text}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        item = normal[r.item_id]
        assert distance(item, docs[r.doc_id][max(0, r.start - 200) : r.start + len(item) + 200]) == r.edits <= 0.2 * len(item)


def test_edge_rows_and_blocks(spark, monkeypatch):
    texts = ["one two three four five six seven", "the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None), (None, "x" * 40)], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame(
        [(1, "x " + texts[0], 5), (1, "x " + texts[0], 5), (None, f"{texts[1]}, {texts[2]}!", 6), (3, None, 7), (4, "clean text", 8)],
        "doc_id BIGINT, text STRING, item_id INT",
    )
    want = [(1, 0, 2, 0), (1, 0, 2, 0), (None, 1, 0, 0), (None, 2, 44, 0)]
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=str) == sorted(want, key=str)
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()) == [3, 4]
    assert decontaminate.leaks(docs, bench.where("false")).collect() == []
    assert decontaminate.leaks(docs.where("false"), bench).collect() == []


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_recall_up_to_the_bound(spark, items, share):
    """Windows start at every word, so an item is found wherever its edits are."""
    random.seed(5)
    prose = [r.text for r in read(spark, "/root/testdata/sf0.01", "documents").limit(60).collect()]
    detect = Detector(items, 0.2)
    found = 0
    for item_id, text in items:
        around = random.choice(prose)
        cut = random.randrange(len(around))
        doc = around[:cut] + "\n" + edited(normalised(text)[1], share) + "\n" + around[cut:]
        found += item_id in [leak[0] for leak in detect.leaks([doc])[0]]
    assert found >= 0.9 * len(items)


def test_alignments_of_many_words_of_bits():
    random.seed(3)
    pairs = []
    for n in (1, 63, 64, 65, 128, 129, 200) * 6:
        item = "".join(random.choice("abc ") for _ in range(n))
        pairs.append((item, "".join(random.choice("abcd ") for _ in range(random.randint(0, 60))) + edited(item, 0.15)))
    assert [edits for edits, _ in decontaminate.best_matches(pairs)] == [distance(*pair) for pair in pairs]
