"""What the cleaning stage leaves holds no window of the benchmark."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_operators import brute_decontamination
from tidemark.llm import decontamination


def windows(text, size=13):
    words = decontamination.normalised(text)
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_no_window_remains(spark):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    passage = benchmark.orderBy("item_id").first()["text"].split()[:13]
    filler = "unlike any of the others these words come from nowhere at all " * 60
    extra = [
        (910001, f"{filler} {' '.join(passage)} {filler}"), (910002, f"{filler} {' '.join(passage[:12])} {filler}"), (910003, f"{filler} short item {filler}"),
        (910004, "a short item"), (910005, None), (910006, ""), (None, filler), (None, " ".join(passage)), (910007, f"{'; '.join(passage).upper()}."), (910007, f"{'; '.join(passage).upper()}."),
    ]
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    documents = documents.withColumn("longest", F.lit("clash")).withColumn("contaminated", F.lit("clash"))
    benchmark = benchmark.unionByName(spark.createDataFrame([("short", "Short item")], "item_id string, text string"))
    rows, items = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.collect()]
    known = set().union(*[windows(text) for _, text in items])
    expected = sorted(repr(row) for row, found in zip(rows, brute_decontamination(rows, items), strict=True) if not found[-1] and not windows(row[1]) & known)
    for block in (decontamination.BLOCK_BYTES, 40_000):
        kept = decontamination.clean_documents(documents, benchmark, block_bytes=block)
        assert kept.columns == documents.columns
        assert sorted(repr((r[0], r[1])) for r in kept.select("doc_id", "text").collect()) == expected
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert {910002, 910003, 910005, 910006} <= set(ids) and ids.count(None) == 1 and not {910001, 910004, 910007} & set(ids)
