import hashlib
import math

import numpy as np
import pytest

from postflow.llm import centroids, queries
from postflow.llm.common import read

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute_force(rows, clusters, rounds, dimensions, seed=2):
    """rows are (vec_id, vector); plain integers throughout."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, hashlib.sha256(f"{seed}:{kept[k][0]}".encode()).hexdigest(), kept[k][1]))
    centers = [list(ints[k]) for k in order[:clusters]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers)) for v in ints]

    for _ in range(rounds):
        groups = {}
        for (_, k), v in zip(assigned(), ints):
            groups.setdefault(k, []).append(v)
        for k, vs in groups.items():
            centers[k] = [sum(column) // len(vs) for column in zip(*vs)]
    last = assigned()
    inertia = {}
    for d, k in last:
        inertia[k] = inertia.get(k, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), names[k]) for (i, _), (d, k) in zip(kept, last)), key=str)


def got(df):
    assert df.dtypes == [
        ("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")
    ]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("width", "cell"), [(1, 7), (2, 1 << 15), (3, 16), (5, 3)])
def test_equal_brute_force(spark, width, cell):
    rng = np.random.default_rng(width)
    # few different values, so that there are ties; an id twice, null ids
    rows = [(int(i), [float(x) / 256 for x in rng.integers(-2, 3, 5)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, [0.5] * 5), (None, [0.25] * 5), (None, [-0.25] * 5), (2**53 + 1, [-1.0, 1.001, -0.0, 1e-9, -1e-9]), (2**53 + 3, [3.0] * 5)]
    bad = [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0] * 6), (904, [1.0, None, 1.0, 1.0, 1.0]), (905, [float("nan")] * 5), (906, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], SCHEMA).repartition(3)
    for clusters, rounds in ((4, 5), (1, 2), (200, 1), (6, 0)):
        found = centroids.cluster(df, clusters, rounds, dimensions=5, cell=cell, width=width)
        assert got(found) == brute_force(rows + bad, clusters, rounds, 5)


def test_codes_lose_nothing():
    rng = np.random.default_rng(1)
    for low, high in ((-3, 3), (-(2**25), 2**25)):
        for width in (1, 2, 3, 7, 64):
            vectors = rng.integers(low, high, (200, 64))
            dictionaries, codes = centroids.encoded(vectors, width)
            assert (centroids.decoded(dictionaries, codes) == vectors).all()
            assert all(len(np.unique(d, axis=0)) == len(d) for d in dictionaries)


def test_large_components(spark):
    rows = [(i, [2.0**17 * (-1) ** i, float(i)], 0) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(centroids.cluster(df, 3, 2, dimensions=2)) == brute_force([r[:2] for r in rows], 3, 2, 2)
    for clusters in (1, 20):
        beyond = spark.createDataFrame([*rows, (11, [2.0**18, 0.0], 0)], SCHEMA)
        with pytest.raises(Exception, match="too large"):
            centroids.cluster(beyond, clusters, 2, dimensions=2).collect()


def test_empty_and_other_columns(spark):
    assert got(centroids.cluster(spark.createDataFrame([], SCHEMA))) == []
    assert got(centroids.cluster(spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], SCHEMA))) == []
    rows = [(i, [i / 3, -i / 7]) for i in range(20)]
    names = ["id", "cluster", "distance", "inertia", "h", "ids", "known", "codes"]
    df = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, " + ", ".join(f"{n} INT" for n in names))
    assert got(centroids.cluster(df, 3, 2, dimensions=2)) == brute_force(rows, 3, 2, 2)


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, sf, "embeddings").collect()]
    assert got(queries.QUERIES["op13_centroids"](spark, sf)) == brute_force(rows, 40, 5, 64)
