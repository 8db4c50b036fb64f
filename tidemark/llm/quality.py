"""Quality rules: surface counts and a hashed n-gram likelihood ratio.

Two multinomials over hashed words and word pairs are counted: one over trusted
documents, one over the whole corpus. A document's score is the mean over its
n-grams of the log of the two probabilities' ratio. The verdict compares the
score with a fixed threshold, so each document's is the same in every run.
Everything is DataFrame functions; weights and scores are whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ngrams
from tidemark.llm.common import SPACES, once

SYMBOLS = "#*$%&|<>"
REPEAT = 8


@dataclass(frozen=True)
class Ratio:
    """Buckets, the least mean log ratio in thousandths of a nat, and how many trusted documents are read at most."""

    buckets: int = ngrams.BUCKETS
    threshold: int = -120
    trusted: int = 20_000


def repeated_words(hashes: Column, repeats: Column) -> Column:
    """Words covered by windows that occur twice; ``repeats`` are the sorted starts of those."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(repeats, zero, lambda a, p: F.struct((p + REPEAT).alias("end"), (a["n"] + F.least(F.lit(REPEAT), p + REPEAT - a["end"])).alias("n")), lambda a: a["n"])


def surface(documents: DataFrame) -> DataFrame:
    """Add ``_hashes``, ``_pairs`` and the surface counts of every text.

    Windows of eight words are compared by 64-bit hashes within one text: pairs
    of words, pairs of those, and pairs again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    df = documents.withColumn("_hashes", ngrams.hashes(ngrams.words(F.col("text")))).withColumn("_lines", lines)
    df = df.withColumn("_pairs", ngrams.neighbours(F.col("_hashes")))
    df = df.withColumn("_windows", F.when(F.size("_hashes") > REPEAT, ngrams.neighbours(ngrams.neighbours(F.col("_pairs"), 2), 4)))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    starts = F.array_sort(F.transform(F.filter("_sorted", lambda e, i: F.coalesce(e["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get("_sorted", i + 1)["h"], F.lit(False))), lambda e: e["at"]))
    return df.select(
        *[F.col(f"`{c}`") for c in documents.columns],
        "_hashes",
        "_pairs",
        F.size("_hashes").cast("bigint").alias("n_words"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(repeated_words(F.col("_hashes"), starts), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` ids of documents labelled good, those of the lowest hashes."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_ratio(documents: DataFrame, labels: DataFrame, ratio: Ratio = Ratio()) -> list[int]:
    """Weights per bucket: trusted documents, a bounded number of them, against all documents."""
    trusted = trusted_ids(labels, ratio.trusted).withColumn("_trusted", F.lit(1))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(trusted), "doc_id", "left")
    sums = ngrams.bucket_counts(rows, {"raw": F.lit(1), "target": F.coalesce("_trusted", F.lit(0))}, ratio.buckets)
    return ngrams.log_ratio(sums["target"], sums["raw"])


def apply_rules(documents: DataFrame, weights: list[int], ratio: Ratio = Ratio()) -> DataFrame:
    """Documents with the surface counts, ``ratio_score`` (thousandths of a nat per n-gram), ``base_failed`` and ``kept``."""
    table = ngrams.table(weights)
    total = ngrams.score_hashes(F.col("_hashes"), table, ratio.buckets) + ngrams.score_hashes(F.col("_pairs"), table, ratio.buckets)
    df = surface(documents).withColumn("_score", total).withColumn("_n", (F.size("_hashes") + F.size("_pairs")).cast("bigint"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    values = {c: F.col(c) for c in RESULTS[:5]}
    values["ratio_score"] = F.when(F.col("_n") > 0, F.col("_score") / F.col("_n")).otherwise(F.lit(0.0))
    values["base_failed"] = failed
    values["kept"] = ~failed & (F.col("_score") >= F.lit(ratio.threshold) * F.col("_n"))
    judged = once(df, "_judged", F.struct(*[v.alias(c) for c, v in values.items()]))
    return judged.select(*[F.col(f"`{c}`") for c in documents.columns], "_judged.*")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio_score", "base_failed", "kept")


def judge(documents: DataFrame, labels: DataFrame, ratio: Ratio = Ratio()) -> DataFrame:
    """Verdicts on all documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio_score, base_failed, kept.

    A null or empty text has no words and fails the base rules. Repeated rows
    are judged alike; a null doc_id is never trusted. Without trusted documents
    all ratios are zero and the base rules alone decide. Extra columns are not
    read, so theirs may have any names.
    """
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return apply_rules(narrow, fit_ratio(narrow, labels, ratio), ratio).select("doc_id", *RESULTS)


def keep_good(documents: DataFrame, labels: DataFrame, ratio: Ratio = Ratio()) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns."""
    taken = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_own")
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), taken)
    judged = apply_rules(narrow, fit_ratio(narrow, labels, ratio), ratio)
    return judged.where("kept").select("_own.*")
