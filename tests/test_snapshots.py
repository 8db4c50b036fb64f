"""Change batches leave a bounded number of folders; failures, names and search paths."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.cache.engine import Config, Engine
from tidemark.plans import cached
from tidemark.reason.spec import Compare, Item, Spec, Table
from tidemark.sources import table
from tidemark.streaming.changes import apply_changes

SPEC = Spec(Table("region"), where=(Compare("r_regionkey", ">", 0),), items=(Item("r_regionkey"), Item("r_name")))


def test_folders_stay_few_over_batches(spark):
    kept = cached.engine(spark, DATA)
    kept.query(SPEC)
    counts = []
    for n in range(6):
        batch = spark.createDataFrame([("U", n, n % 5, f"name {n}")], "op string, lsn long, r_regionkey int, r_name string")
        apply_changes(kept, "region", batch)
        counts.append(len(list(Path(kept.store.root.removeprefix("file:")).iterdir())))
    assert max(counts) <= 8 and counts[-1] <= counts[1] + 2
    assert sorted(map(tuple, kept.query(SPEC).collect())) == [(1, "name 1"), (2, "name 2"), (3, "name 3"), (4, "name 4")]


def test_names_are_bound_for_one_text(spark):
    spark.range(1).createOrReplaceTempView("region")
    kept = cached.engine(spark, DATA)
    assert kept.query(SPEC).count() == 4 and kept.sql("SELECT r_name FROM region NATURAL JOIN region AS b").count() == 5
    assert spark.table("region").columns == ["id"]
    spark.catalog.dropTempView("region")


def test_failed_load_is_answered_from_base(spark, monkeypatch):
    kept = cached.engine(spark, DATA)

    def fails(spec, need):
        raise OSError("no space")

    monkeypatch.setattr(kept, "_populate", fails)
    assert kept.query(SPEC).count() == 4
    assert kept.metrics.failures == 1 and not kept.entries


def test_search_path(spark):
    region = table(spark, DATA, "region")
    tables = {"a__region": region.where("r_regionkey < 2"), "b__region": region}
    keys = {name: ["r_regionkey"] for name in tables}
    assert Engine(spark, tables, keys, Config(search_path=("a", "b"))).query(SPEC).count() == 1
    assert Engine(spark, tables, keys, Config(search_path=("b", "a"))).sql("SELECT region.r_name FROM region WHERE region.r_regionkey > 0").count() == 4
    assert Engine(spark, tables, keys).sql("SELECT r_name FROM a.region").count() == 2


def test_updates_need_a_key(spark):
    kept = cached.engine(spark, DATA)
    lines = table(spark, DATA, "lineitem").limit(1)
    with pytest.raises(ValueError, match="no key"):
        apply_changes(kept, "lineitem", lines.select(F.lit("U").alias("op"), F.lit(1).alias("lsn"), *lines.columns))


def test_waiting_queries_lose_credit(spark):
    kept = cached.engine(spark, DATA, admission_threshold=3, decay_every=2)
    kept.query(SPEC)
    for n in range(5):
        kept.query(Spec(Table("nation"), where=(Compare("n_nationkey", ">", n),)))
    assert not any(e.spec == SPEC for e in kept.entries.values())
