"""Hashed word n-grams as DataFrame expressions, counted and scored on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_RUN, SPACES

#: Buckets of the n-gram hash: a power of two, and the size of every weight table.
BUCKETS = 8192


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN, -1))


def hashes(word_list: Column) -> Column:
    return F.transform(word_list, lambda w: F.xxhash64(w))


def neighbours(values: Column, step: int = 1) -> Column:
    """Hashes of each value with the one ``step`` further on; empty where there is none."""
    n = F.size(values) - step
    joined = F.zip_with(F.slice(values, 1, n), F.slice(values, step + 1, n), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 0, joined).otherwise(F.array().cast("array<bigint>"))


def bucket(value: Column, buckets: int = BUCKETS) -> Column:
    return value.bitwiseAND(F.lit(buckets - 1).cast("bigint")).cast("int")


def bucket_counts(texts: DataFrame, weights: dict[str, Column], buckets: int = BUCKETS) -> dict[str, list[int]]:
    """Per bucket, the sums of integer row weights over all words and pairs of neighbours of ``text``.

    Words are paired and exploded before they are hashed, which keeps the whole
    count in generated code. At most ``buckets`` rows reach the driver.
    """
    listed = texts.select(*[w.cast("bigint").alias(name) for name, w in weights.items()], words(F.col("text")).alias("w"))
    pairs = listed.select(*weights, F.inline(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("after"))))
    single = F.xxhash64("w")
    both = F.when(F.col("after").isNotNull(), bucket(F.xxhash64(single, F.xxhash64("after")), buckets))
    grams = pairs.select(*weights, F.explode(F.array(bucket(single, buckets), both)).alias("bucket")).where("bucket IS NOT NULL")
    return _gathered(grams, list(weights), buckets)


def bucket_sums(rows: DataFrame, grams: str, weights: dict[str, Column], buckets: int = BUCKETS) -> dict[str, list[int]]:
    """The same over a column of buckets."""
    grams = rows.select(*[w.cast("bigint").alias(name) for name, w in weights.items()], F.explode(grams).alias("bucket"))
    return _gathered(grams, list(weights), buckets)


def _gathered(grams: DataFrame, names: list[str], buckets: int) -> dict[str, list[int]]:
    out = {name: [0] * buckets for name in names}
    for row in grams.groupBy("bucket").agg(*[F.sum(name).alias(name) for name in names]).collect():
        for name in names:
            out[name][row["bucket"]] = int(row[name] or 0)
    return out


#: Weights are whole numbers of this fraction of a nat, so that scores are exact sums in any order.
SCALE = 1000


def log_ratio(target: list[int], base: list[int], smoothing: float = 1.0) -> list[int]:
    """Per bucket, the scaled log of its probability under ``target`` over that under ``base``; all zero if either is empty."""
    if not any(target) or not any(base):
        return [0] * len(base)
    t, b = sum(target) + smoothing * len(target), sum(base) + smoothing * len(base)
    return [round(SCALE * math.log((x + smoothing) / t * b / (y + smoothing))) for x, y in zip(target, base, strict=True)]


def table(values: list[int]) -> Column:
    """A weight table as one folded literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def score(grams: Column, weights: Column) -> Column:
    """The sum of the weights of buckets."""
    return F.aggregate(grams, F.lit(0).cast("bigint"), lambda total, g: total + F.get(weights, g))


def score_hashes(values: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    """The sum of the weights of hashes' buckets."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, h: total + F.get(weights, bucket(h, buckets)))
