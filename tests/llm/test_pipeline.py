"""The pipeline's stages, one by one, against plain versions of what they say."""

import corpus_pipeline
import pytest
from test_line_dedup import brute_force as plain_lines
from test_ngram_join import brute_force as plain_groups
from test_packing import check as check_packing

import __spark_entry__
from postflow.llm import queries
from postflow.llm.common import read
from postflow.llm.decontaminate import normalised

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and gives, written and read again as the driver does it."""
    found, docs = {}, read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        found[name] = docs, result
        docs = result
    return found


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    for name, (docs, result) in stages.items():
        if name != "packing":
            assert result.dtypes == docs.dtypes


def test_quality_rules(spark, stages):
    docs, result = stages["quality_rules"]
    kept = {r.doc_id for r in queries.op4_quality_rules(spark, SF).where("kept").collect()}
    assert sorted(texts(result)) == sorted((d, t) for d, t in texts(docs) if d in kept)
    quality = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    ids = {d for d, _ in texts(result)}
    bad, good = [d in ids for d, q in quality.items() if q == 0], [d in ids for d, q in quality.items() if q == 1]
    assert sum(bad) < 0.1 * len(bad) and sum(good) > 0.95 * len(good)


def test_line_dedup(stages):
    docs, result = stages["line_dedup"]
    assert sorted(texts(result)) == sorted((d, t) for d, _, _, t in plain_lines(texts(docs), 1))
    assert all(r.n_chars == len(r.text) for r in result.collect())


def test_groups(stages):
    docs, result = stages["ngram_jaccard"]
    groups = plain_groups(texts(docs))
    assert sorted(d for d, _ in texts(result)) == sorted(d for d, n, c in groups if n == 0 or d == c)


def test_decontamination(spark, stages):
    docs, result = stages["decontamination"]
    items = [normalised(r.text)[1] for r in read(spark, SF, "benchmark").collect()]
    kept = dict(texts(result))
    for doc_id, text in texts(docs):
        if any(item in normalised(text)[1] for item in items):
            assert doc_id not in kept
    assert len(kept) > 0.8 * len(texts(docs))


def test_packing(stages):
    docs, result = stages["packing"]
    check_packing(result.collect(), dict(texts(docs)))


def test_run_is_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_edge_rows_go_through_all_stages(spark):
    text = "The first line of a document, long enough to be compared.\nAnother line of it, which is also long enough for that."
    rows = [(1, text, "en", "a", 1, 7), (1, text, "en", "a", 1, 7), (2, text, None, None, None, 8), (None, None, "en", "a", 0, 9), (3, "", "en", "a", 0, 9)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, n_lines INT")
    for cut in ("true", "false"):
        step = docs.where(cut)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, SF)
            assert step.dtypes == docs.dtypes, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, step, SF).collect()
        assert {r.doc_id for r in pieces} <= {1, 2}
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs.where("doc_id < 3"), SF).collect()) == [1]
