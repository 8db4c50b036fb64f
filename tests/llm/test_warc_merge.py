"""The merge gives the whole order and holds a bounded part of it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import warc


def captures(rng, n):
    return [
        {"page_id": None if rng.random() < 0.02 else int(rng.integers(0, 500)), "payload_bytes": 1, "payload_digest": "d", "record_type": "response", "refers_to": None, "url": "u",
         "url_key": "hot" if rng.random() < 0.3 else f"k{rng.integers(0, 200):03}", "captured": f"t{rng.integers(0, 50):02}", "archive": f"a{rng.integers(0, 9)}", "position": int(i), "stored": 1}
        for i in range(n)
    ]


def stream(runs, block):
    rows = []
    for name, run in enumerate(runs):
        ordered = sorted(run, key=warc._order_key)
        rows += [{**r, "run": f"{name:03}", "step": i, "lead": {c: ordered[i - i % block][c] for c in warc.ORDER}} for i, r in enumerate(ordered)]
    rows.sort(key=lambda r: (warc._order_key(r["lead"]), r["run"], r["step"]))
    schema = pa.schema([*warc.CAPTURE_SCHEMA, ("run", pa.string()), ("step", pa.int64()), ("lead", warc.LEAD_TYPE)])
    return [pa.RecordBatch.from_pylist(rows[i : i + 37], schema=schema) for i in range(0, len(rows), 37)]


def test_merged_by_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    runs = [captures(rng, int(n)) for n in rng.integers(1, 400, 12)]
    expected = [warc._order_key(r) for r in sorted((r for run in runs for r in run), key=warc._order_key)]
    most = 0

    class Watched(warc.LoserTree):
        def __init__(self, slices):
            nonlocal most
            most = max(most, sum(map(len, slices)))
            super().__init__(slices)

    monkeypatch.setattr(warc, "LoserTree", Watched)
    for block, budget in ((1, 50), (8, 100), (8, 1), (1000, 100_000)):
        most = 0
        out = [key for batch in warc.merged(stream(runs, block), budget) for key in warc._keys(batch)]
        assert sorted(out) == sorted(expected) and out == expected
        assert most <= max(12 * block, 37) * 2 + budget + 37 or budget == 100_000
    assert list(warc.merged([])) == []


def test_history_of_many_runs(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") * 7919 % 97).cast("string"), F.lit(".org/p")).alias("url"), F.concat(F.lit("x"), (F.col("id") % 1000).cast("string")).alias("html"))
    folder = warc._qualified(spark, warc.shared_dir(spark))
    assert folder.startswith("file:///")
    archives = warc.write_archives(warc.deduplicated(pages.repartition(5).checkpoint()), folder, records_per_archive=100)
    runs = warc.read_runs(archives, folder, run_rows=70, merge_rows=200).checkpoint()
    assert runs.select("run").distinct().count() > 40
    out = warc.merge_runs(runs, merge_rows=200).collect()
    assert len(out) == 3000
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in out]
    assert keys == sorted(keys)
    assert sum(r["record_type"] == "response" for r in out) == 1000


def test_long_payload(spark):
    text = "é" * 3_000_000
    got = warc.archive_pages(spark.createDataFrame([(1, "http://a.org", text), (2, None, text)], "page_id long, url string, html string").withColumn("run", F.lit(1)).withColumn("lead", F.lit(1))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(1, 6_000_000, "revisit", 2), (2, 6_000_000, "response", None)]
