"""Tables stored by a column: pruned reads, replaced partitions, builds that leave what has not changed."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import store, tables

SCHEMA = "id long, text string, yr int"


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, f"t{i}", 1990 + i % 6) for i in range(60)] + [(60, None, 1990)], SCHEMA)


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_only_the_partitions_of_a_filter_are_read(spark, rows):
    path = store.new_path(spark, "t-years")
    tables.store_by(rows, path, "yr")
    every = tables.stored_by(spark, path, SCHEMA, "yr")
    assert sorted(map(tuple, every.select("id", "text", "yr").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    wanted = rows.where("id in (3, 9, 4)")
    some = tables.stored_by(spark, path, SCHEMA, "yr", wanted)
    assert {r.yr for r in some.select("yr").distinct().collect()} == {1993, 1994}
    assert files(some) < files(every) and len(files(some)) <= len(files(every)) / 2
    assert "PartitionFilters: [yr" in some.select("id")._jdf.queryExecution().executedPlan().toString()
    assert tables.stored_by(spark, path, SCHEMA, "yr", wanted.limit(0)).count() == 0


def test_a_join_prunes_where_values_are_many(spark, rows, monkeypatch):
    monkeypatch.setattr(tables, "MOST_VALUES", 1)
    path = store.new_path(spark, "t-years")
    tables.store_by(rows, path, "yr")
    some = tables.stored_by(spark, path, SCHEMA, "yr", rows.where("text = 't3' or text = 't4'"))
    assert some.count() == 20 and "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()


def test_storing_replaces_the_partitions_it_has(spark, rows):
    path = store.new_path(spark, "t-years")
    tables.store_by(rows, path, "yr")
    tables.store_by(spark.createDataFrame([(7, "new", 1991)], SCHEMA), path, "yr")
    t = tables.stored_by(spark, path, SCHEMA, "yr")
    assert t.where("yr = 1991").select("text").collect() == [("new",)] and t.count() == 52


def test_a_build_leaves_what_has_not_changed(spark, rows):
    path = store.new_path(spark, "t-years")
    assert tables.build_if_changed(rows, path, SCHEMA, "yr") == list(range(1990, 1996))
    before = files(tables.stored_by(spark, path, SCHEMA, "yr"))
    assert tables.build_if_changed(rows.repartition(3), path, SCHEMA, "yr") == []
    assert files(tables.stored_by(spark, path, SCHEMA, "yr")) == before
    changed = rows.withColumn("text", F.when(F.col("id") == 8, "other").otherwise(F.col("text")))
    assert tables.build_if_changed(changed, path, SCHEMA, "yr") == [1992]
    assert tables.stored_by(spark, path, SCHEMA, "yr").where("text = 'other'").count() == 1
    assert tables.build_if_changed(rows.limit(0), store.new_path(spark, "t-none"), SCHEMA, "yr") == []
