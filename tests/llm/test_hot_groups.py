"""Groups over a chunk: no link is lost, and members that the pivot settles aren't compared again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_groups, multiset
from tidemark.llm import neardup
from tidemark.llm.common import attach


def family(start, n, seed, changes, length=120):
    rng = np.random.default_rng(seed)
    source = [f"s{seed}w{x}" for x in rng.integers(0, 400, length)]
    out = []
    for i in range(n):
        copy = list(source)
        for at in rng.integers(0, length, int(rng.integers(0, changes))):
            copy[at] = f"x{start + i}"
        out.append((start + i, " ".join(copy)))
    return out


def chain(start, n, length=150):
    """Each text shares most of its words with the next, and little with those further on."""
    return [(start + i, " ".join(f"c{x}" for x in range(i * 5, i * 5 + length))) for i in range(n)]


@pytest.mark.parametrize("chunk", [3, 7])
def test_hot_groups(spark, chunk, monkeypatch):
    monkeypatch.setattr(neardup, "SKETCH_CHUNK", chunk)
    monkeypatch.setattr(neardup, "TEXT_CHUNK", chunk)
    rows = family(0, 60, 1, 4) + family(1000, 30, 2, 14) + chain(2000, 25) + family(3000, 2, 3, 1)
    rows += [(5000 + i, rows[0][1]) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).checkpoint()
    rule = neardup.Rule(3, 85)
    found = [tuple(r) for r in neardup.near_duplicates(frame, rule).select("doc_id", "n_shingles", "component_id").collect()]
    assert multiset(found) == multiset(brute_groups(rows, 3, 85))


def test_settled_pairs_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TEXT_CHUNK", 4)
    seen = []
    inner = neardup._linked_in_full

    def watched(blocks, rule):
        blocks = blocks.checkpoint()
        seen.append(blocks.count())
        return inner(blocks, rule)

    monkeypatch.setattr(neardup, "_linked_in_full", watched)
    rows = family(0, 80, 5, 3, length=300)
    frame = spark.createDataFrame(rows, "doc_id long, text string").checkpoint()
    assert neardup.near_duplicates(frame, neardup.Rule(3, 85)).select("component_id").distinct().count() == 1
    assert len(seen) == 1 and seen[0] < 2 * len(rows)


def test_attach_heavy_and_null_keys(spark):
    rows = spark.range(6000).select((F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id"))).cast("bigint").alias("k"), "id")
    unique = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    found = attach(rows, unique, "k", "n")
    assert found.columns == ["k", "id", "top"]
    plain = rows.join(unique.drop("n"), "k", "left").select("k", "id", "top")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
