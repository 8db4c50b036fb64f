"""Texts that nothing asks for aren't shuffled, and a sieve loses no row that is asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_hot_groups import family
from tests.llm.test_operators import brute_groups, multiset
from tidemark.llm import common, neardup


@pytest.fixture
def large_tables(spark):
    """Joins as large tables are joined: nothing small enough to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def shuffled(spark, work):
    """What ``work`` gives, and the bytes that its stages wrote to shuffles."""
    context = spark.sparkContext._jsc.sc()
    first = context.dagScheduler().nextStageId()
    out = work()
    context.listenerBus().waitUntilEmpty()
    total = 0
    for stage in range(first, context.dagScheduler().nextStageId()):
        try:
            total += context.statusStore().lastStageAttempt(stage).shuffleWriteBytes()
        except Exception:  # skipped stages aren't kept
            pass
    return out, total


def lone_and_near(n=150, length=6000):
    """Long texts that are like no other, and two near copies."""
    rng = np.random.default_rng(23)
    rows = [(i, " ".join(map(str, rng.integers(0, 1 << 60, length)))) for i in range(n)]
    return rows + family(n, 2, 3, 2), sum(len(t) for _, t in rows)


def test_texts_without_a_cluster_are_not_shuffled(spark, large_tables):
    rows, size = lone_and_near()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    found, moved = shuffled(spark, lambda: neardup.near_duplicates(frame, neardup.Rule(3, 85)).collect())
    assert multiset([tuple(r)[:3] for r in found]) == multiset(brute_groups(rows, 3, 85))
    assert 0 < moved < size / 5


def test_kept_rows_are_not_shuffled(spark, large_tables):
    rows, size = lone_and_near()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    found, moved = shuffled(spark, lambda: neardup.keep_one(frame).collect())
    assert sorted(tuple(r) for r in found) == rows[:-1]
    assert 0 < moved < size / 5


@pytest.mark.parametrize("most", [1 << 15, 1 << 26])
def test_sieve_misses_no_key(spark, most, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_BITS", most)
    rows = spark.range(-50_000, 50_000).select(F.when(F.col("id") % 9 > 0, F.col("id") * 7919).alias("k"), "id")
    keys = rows.where("id % 10 = 0 AND k IS NOT NULL").select("k").checkpoint()
    found = common.may_be_among(rows, keys, "k", "maybe")
    assert found.columns == ["k", "id", "maybe"] and found.count() == 100_000
    assert found.where("k IS NULL AND maybe").isEmpty()
    assert found.join(keys, "k").where("NOT maybe").isEmpty()
    if most > 1 << 15:
        assert found.where("maybe AND id % 10 <> 0").count() < 100_000 / 10


def test_sieve_of_no_key(spark):
    rows = spark.range(10)
    assert common.may_be_among(rows, rows.where("id < 0").checkpoint(), "id", "maybe").where("maybe").isEmpty()


def test_false_hits_change_nothing(spark, large_tables, monkeypatch):
    rows = family(0, 40, 1, 4) + family(1000, 30, 2, 14) + [(5000 + i, f"lone {i} " * 9 + f"x{i}") for i in range(60)]
    rows += [(7, "another text of a used id"), (5003, "lone 3 " * 9 + "x3"), (None, rows[0][1]), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).checkpoint()

    def results():
        return multiset(map(tuple, neardup.near_duplicates(frame).collect())), multiset(map(tuple, neardup.keep_one(frame).collect()))

    plain = results()

    def all_asked(rows, keys, key, name):
        return rows.withColumn(name, F.col(key).isNotNull())

    monkeypatch.setattr(neardup, "may_be_among", all_asked)
    assert results() == plain
