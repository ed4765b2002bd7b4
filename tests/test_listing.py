"""The time listing: rows of a range, buckets that are not read, completeness, pages."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postflow import schemas
from postflow.operators import state as S
from postflow.plans.jobs import Warehouse, reindex_year
from postflow.sinks import listing
from postflow.sinks.tables import id_bucket
from postflow.sources.lists import scan_state_by_year


def times(i):
    return [None, "not a time", "2018-12-31T23:59:59.000Z"][i % 3] if i % 10 == 9 else f"20{18 + i % 7}-0{1 + i % 9}-11T10:00:0{i % 5}.000Z"


@pytest.fixture
def house(spark, tmp_path):
    built = Warehouse(str(tmp_path / "house"), buckets=32)
    write(built, spark, [(str(i), times(i)) for i in range(300)] + [("lone", "1999-05-05T00:00:00.000Z")], "b.0")
    listing.rebuild(spark, built.times, built.state)
    return built


def rows_of(spark, house, rows):
    given = spark.createDataFrame(rows, "id STRING, created_at STRING")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.STATE if f.name not in ("id", "created_at")]
    return given.select("id", "created_at", *empty, id_bucket(F.col("id"), house.buckets).alias("bucket")).withColumn("text", F.concat(F.lit("t"), "id"))


def write(house, spark, rows, tag):
    """A batch that changes these rows of the state table."""
    changes = rows_of(spark, house, rows)
    kept = house.state.touched(house.state.read(spark), changes).join(changes.select("id"), "id", "left_anti")
    house.state.write(kept.unionByName(changes), tag)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def in_year(spark, house, year):
    return listing.in_listed_buckets(house.state.read(spark), house.times.read(spark), f"{year}-", f"{year + 1}-")


@pytest.mark.parametrize("year", [1999, 2017, 2018, 2019, 2024])
def test_rows_are_those_of_the_scan(spark, house, year):
    assert ids(in_year(spark, house, year)) == ids(scan_state_by_year(house.state.read(spark), str(year)))


def test_other_buckets_are_not_read(spark, house):
    bucket = house.times.read(spark).where("id = 'lone'").first().bucket
    for path in Path(house.root, "state").glob("v=*/bucket=*/*.parquet"):
        if f"bucket={bucket}/" not in str(path):
            path.with_name(f".{path.name}.crc").unlink()
            path.write_bytes(b"cannot be read")
    with pytest.raises(Exception, match="(?i)parquet"):
        scan_state_by_year(house.state.read(spark), "1999").collect()
    assert ids(in_year(spark, house, 1999)) == ["lone"]
    reindex_year(house, spark, "1999", "reindex.1999")
    assert ids(house.gold.read(spark)) == ["lone"]


def test_a_batch_that_is_not_listed_is_found_out(spark, house):
    assert listing.is_complete(spark, house.times, house.state)
    write(house, spark, [("late", "1999-07-01T00:00:00.000Z")], "b.1")
    assert not listing.is_complete(spark, house.times, house.state)
    reindex_year(house, spark, "1999", "reindex.a")
    assert ids(house.gold.read(spark)) == ["late", "lone"]
    house.times.write(listing.listing_rows(rows_of(spark, house, [("late", "1999-07-01T00:00:00.000Z")])), "b.1")
    assert listing.is_complete(spark, house.times, house.state)
    assert ids(in_year(spark, house, 1999)) == ["late", "lone"]


def test_a_changed_time_counts_as_it_is_now(spark, house):
    moved = [("lone", "2001-01-01T00:00:00.000Z")]
    write(house, spark, moved, "b.1")
    house.times.write(listing.listing_rows(rows_of(spark, house, moved)), "b.1")
    assert ids(in_year(spark, house, 1999)) == [] and ids(in_year(spark, house, 2001)) == ["lone"]
    listing.rebuild(spark, house.times, house.state)
    assert listing.is_complete(spark, house.times, house.state)
    assert [r.created_at for r in house.times.read(spark).where("id = 'lone'").collect()] == [moved[0][1]]


def test_pages_and_empty_tables(spark, house, tmp_path):
    found, after = [], None
    house.times.write(house.times.read(spark).where("id < '2'"), "again")
    while page := listing.listed_page(house.times.read(spark), after, 40).collect():
        found += page
        after = page[-1].created_at, page[-1].id
    usable = house.state.read(spark).where("try_to_timestamp(created_at) IS NOT NULL")
    assert [(r.created_at, r.id) for r in found] == [(r.created_at, r.id) for r in S.time_listing(usable).collect()]
    empty = Warehouse(str(tmp_path / "empty"))
    assert listing.is_complete(spark, empty.times, empty.state)
    assert in_year(spark, empty, 2020).collect() == [] and listed_none(spark, empty)


def listed_none(spark, house):
    return listing.listed_page(house.times.read(spark)).collect() == []
