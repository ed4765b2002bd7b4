import random

import pytest
from pyspark.sql import functions as F

from postflow.operators import geo_index as G
from postflow.operators import query as Q


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    points = [[rng.uniform(-180, 180), rng.uniform(-90, 90)] for _ in range(3000)]
    points += [[180.0, 0.0], [-180.0, 0.0], [0.0, 90.0], [10.0, -90.0], [200.0, 10.0], [5.0, 5.0], [4.999999, 5.0], [10.0, 10.0], [179.99, 89.9], [-179.99, 89.9]]
    rows = [(str(i), p) for i, p in enumerate(points)] + [("none", None), ("empty", []), ("half", [3.0]), ("null", [None, 2.0]), ("nan", [float("nan"), 1.0])]
    docs = spark.createDataFrame(rows, "id STRING, p ARRAY<DOUBLE>").select("id", F.struct(F.struct(F.col("p").alias("coordinates")).alias("coordinates")).alias("geo"))
    path = str(tmp_path_factory.mktemp("geo") / "t")
    G.write_clustered(docs, path)
    return docs, G.read_clustered(spark, path, docs)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


BOXES = [(-10, -20, 40, 60), (170, -50, -170, 50), (-180, -90, 180, 90), (5, 5, 10, 10), (4.5, 4.5, 4.6, 4.6), (0, 20, 10, 10), (179, 80, -179, 90)]
PLACES = [(135, 35, 4000), (179.5, 10, 800), (-179.5, -10, 800), (0, 89, 500), (10, -90, 3000), (5, 5, 0), (20, 60, 9000), (0, 0, 20020), (100, 80, 1200)]


@pytest.mark.parametrize("box", BOXES)
def test_boxes(tables, box):
    docs, clustered = tables
    assert ids(G.in_box(clustered, *box)) == ids(Q.geo_box(docs, *box).where("NOT isnan(geo.coordinates.coordinates[0])"))


@pytest.mark.parametrize("place", PLACES)
def test_radius(tables, place):
    docs, clustered = tables
    assert ids(G.within_km(clustered, *place)) == ids(Q.geo_distance(docs, *place))


def test_all_rows_are_there(tables):
    docs, clustered = tables
    assert ids(clustered) == ids(docs)


def test_other_files_are_not_read(tables):
    _, clustered = tables
    found = G.in_box(clustered, 5, 5, 9, 9)
    files = clustered.select("_metadata.file_path").distinct().count()
    read = G.near_cells(clustered, G.runs(5, 5, 9, 9)).select("_metadata.file_path").distinct().count()
    assert read == 1 and files > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [geo_row" in plan.replace("isnotnull(geo_row", "geo_row") and "PushedFilters: [" in plan and "geo_cell" in plan.split("PushedFilters")[1]
