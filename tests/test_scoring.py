import threading
import time

import pandas as pd
import pytest

from postflow.operators import analysis as A


def models():
    """Made here, so that workers, which do not know this module, get them by value."""

    def neutral(texts, langs):
        return pd.DataFrame({"sentiment": ["NEUTRAL"] * len(texts), **{n: [0.25] * len(texts) for n in A.LABELS}})

    def nothing(texts, langs):
        return pd.Series([[] for _ in range(len(texts))])

    return neutral, nothing


def frame(n, start=0):
    ids = [f"k{i}" for i in range(start, start + n)]
    return pd.DataFrame({"cache_key": ids, "normalized_text": ids, "language_code": "en", "posts": 1})


def test_calls_in_flight_are_bounded_and_results_in_order():
    neutral, nothing = models()
    lock, now, most = threading.Lock(), [0], [0]

    def slow(texts, langs):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01 if texts[0].endswith("0") else 0.002)
        with lock:
            now[0] -= 1
        return neutral(texts, langs)

    scorer = A.PandasScorer(slow, nothing, batch_size=1, in_flight=3)
    taken = []

    def source():
        for start in (0, 20):
            taken.append(start)
            yield frame(20, start)

    run = scorer._run(source())
    first = next(run)
    assert taken == [0]  # no further batch is taken before it is needed
    out = pd.concat([first, *run])
    assert out["cache_key"].tolist() == [f"k{i}" for i in range(40)] and 1 < most[0] <= 3


def test_flaky_models_give_the_same_rows_and_attempts_are_counted(spark):
    neutral, nothing = models()
    rows = spark.createDataFrame([(f"k{i}", f"k{i}", "en", 1) for i in range(30)], "cache_key STRING, normalized_text STRING, language_code STRING, posts BIGINT")
    tries = {}

    def flaky(texts, langs):
        key = texts[0]
        tries[key] = tries.get(key, 0) + 1
        if tries[key] <= int(key[1:]) % 3:
            raise OSError("busy")
        return neutral(texts, langs)

    steady = A.PandasScorer(neutral, nothing, batch_size=1, partitions=2).score(rows).collect()
    shaky = A.PandasScorer(flaky, nothing, batch_size=1, partitions=2, pause=0.001).score(rows).collect()
    plain = lambda rs: sorted((r.cache_key, r.result.sentiment, r.ok, r.posts) for r in rs)
    assert plain(steady) == plain(shaky)
    assert {r.attempts for r in steady} == {2}
    assert {r.cache_key: r.attempts for r in shaky} == {f"k{i}": 2 + i % 3 for i in range(30)}


def test_pauses_double_to_a_bound_and_are_the_same_in_a_repeated_task():
    waits = []
    for key in ("a", "a", "b"):
        calls = A._Calls(1.0, 8.0, key)
        waits.append([calls.wait(k) for k in range(6)])
    assert waits[0] == waits[1] != waits[2]
    for k, wait in enumerate(waits[0]):
        assert min(8, 2**k) / 2 <= wait <= min(8, 2**k)


def test_after_the_last_attempt_the_error_is_raised():
    def broken(texts, langs):
        raise OSError("down")

    scorer = A.PandasScorer(broken, models()[1], batch_size=1, in_flight=2, detect_retries=2, pause=0.001)
    with pytest.raises(OSError, match="down"):
        list(scorer._run(iter([frame(50)])))
