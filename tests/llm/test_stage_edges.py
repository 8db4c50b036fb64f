"""The stages on nulls, empty and long texts, repeated rows, empty tables and clashing columns; what they leave behind."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tidemark.llm.common import made_folders, shared_dir, sweep

GOOD = "It is a plain sentence with words of its own, number {0}, and it goes on for some time before it ends. Another follows it, number {0} as well."
ROWS = [(None, GOOD.format("none")), (1, None), (2, ""), (3, " \n "), (4, GOOD.format(4)), (4, GOOD.format(4)), (5, GOOD.format("five") * 2), (6, " ".join(f"w{i}" for i in range(40_000)))]
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for clash in ("_own", "kept", "found", "piece", "longest", "_id", "node", "n_chars"):
        out = out.withColumn(clash, F.lit(7))
    return out.checkpoint()


@pytest.mark.parametrize("name", list(STAGES))
def test_stage(spark, name):
    docs = frame(spark, ROWS)
    out = STAGES[name](spark, docs, DATA)
    if name != "best-fit packing":
        assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str)
    expected = {
        "quality rules": {1: 0, 2: 0, 3: 0}, "near dedup": {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}, "decontamination": {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1},
        "secret scans": {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}, "best-fit packing": {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1},
    }[name]
    assert {k: ids.count(k) for k in expected} == expected
    assert STAGES[name](spark, docs.limit(0), DATA).count() == 0


def test_run_leaves_its_result_alone(spark):
    since = len(made_folders(spark))
    corpus_pipeline.run(spark, DATA)
    left = made_folders(spark)[since:]
    assert len(left) == 1 and os.path.isdir(left[0])
    sweep(spark, since)
    assert not os.path.exists(left[0]) and len(made_folders(spark)) == since


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(type(context), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(context), "getConf", lambda self: type("Conf", (), {"get": lambda self, key, default=None: None})())
    monkeypatch.setattr(context, "master", "spark://somewhere:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(spark)
