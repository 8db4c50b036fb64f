from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.plans import cached
from tidemark.reason.analysis import fingerprint
from tidemark.reason.spec import Compare, Item, Spec, Table
from tidemark.streaming.changes import apply_changes, follow, net_changes

SPEC = Spec(Table("orders"), where=(Compare("o_totalprice", ">", 300000),), items=(Item("o_orderkey"),))


def keys(df):
    return sorted(r[0] for r in df.collect())


def test_admission_after_hits(spark):
    kept = cached.engine(spark, DATA, admission_threshold=3)
    for _ in range(3):
        kept.query(SPEC)
    assert kept.metrics.populations == 1
    kept.query(SPEC)
    assert kept.metrics.hits == 1


def test_allowlist_and_disconnect(spark):
    kept = cached.engine(spark, DATA, allowed_tables=frozenset(["customer"]))
    kept.query(SPEC)
    assert kept.metrics.bypassed == 1 and not kept.entries
    kept.configure(allowed_tables=None)
    kept.connected = False
    kept.query(SPEC)
    assert kept.metrics.bypassed == 2


@pytest.mark.parametrize("policy", ["fifo", "clock"])
def test_eviction_spares_pinned(spark, policy):
    kept = cached.engine(spark, DATA, policy=policy)
    kept.pin(SPEC)
    others = [replace(SPEC, where=(Compare("o_totalprice", "<", x),)) for x in (100000, 200000, 250000)]
    for s in others:
        kept.query(s)
    kept.configure(cache_size=kept.size() - 1)
    kept.query(Spec(Table("region")))
    assert kept.metrics.evictions >= 1
    assert fingerprint(SPEC) in kept.entries
    assert fingerprint(others[0]) not in kept.entries


def test_batch_twice_changes_nothing(spark):
    kept = cached.engine(spark, DATA)
    kept.query(SPEC)
    batch = cached.changes(spark, DATA)
    apply_changes(kept, "orders", batch)
    once = keys(kept.query(SPEC))
    apply_changes(kept, "orders", batch)
    assert keys(kept.query(SPEC)) == once == keys(kept._run(SPEC, kept.base))


def test_pinned_loads_again(spark):
    kept = cached.engine(spark, DATA)
    kept.pin(cached._NOT_IN)
    apply_changes(kept, "orders", cached.changes(spark, DATA))
    before = kept.metrics.hits
    assert sorted(kept.query(cached._NOT_IN).collect()) == sorted(kept._run(cached._NOT_IN, kept.base).collect())
    assert kept.metrics.hits == before + 1


def test_last_event_of_a_key_counts(spark):
    rows = [("I", 1, 7, "a", None), ("U", 2, 8, "b", 7), ("D", 3, 9, "c", None), ("I", 4, 9, "d", None)]
    net = net_changes(spark.createDataFrame(rows, "op string, lsn long, k long, v string, old_k long"), ["k", "v"], ["k"])
    assert sorted((r["k"], r["op"], r["v"]) for r in net.collect()) == [(7, "D", "b"), (8, "U", "b"), (9, "I", "d")]


def test_changelog_stream(spark, tmp_path):
    kept = cached.engine(spark, DATA)
    kept.query(SPEC)
    first = kept.base["orders"].orderBy(F.desc("o_totalprice")).first()["o_orderkey"]
    row = f'{{"o_orderkey": {first}}}'
    log = spark.createDataFrame([("D", 5, "orders", row, None), ("I", 6, "nowhere", "{}", None)], "op string, lsn long, `table` string, row string, key string")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    follow(kept, stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert first not in keys(kept.query(SPEC))
    assert keys(kept.query(SPEC)) == keys(kept._run(SPEC, kept.base))
    assert kept.applied["orders"] == 5
