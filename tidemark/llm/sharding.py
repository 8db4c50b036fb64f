"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows get global numbers in the order of their key. A balanced Feistel network
over the smallest even number of bits that holds the row count permutes the
numbers; a value outside the range walks along its cycle until it is back
inside, so the network acts as a permutation of exactly 0..n-1. A row's place
``p`` gives shard ``p % shards`` and slot ``p // shards``: both are computable
for any row number without looking at any other row, and counts differ by one
at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import numbered, ship

#: The round function computes in a prime field whose products fit in 63 bits.
PRIME = 2147483647


def round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round."""
    draw = np.random.Generator(np.random.PCG64(seed)).integers(1, PRIME, size=(rounds, 2))
    return [(int(a), int(b)) for a, b in draw]


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..n-1."""

    n: int
    seed: int = 0
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, -(-max(self.n - 1, 1).bit_length() // 2))

    def _mix(self, value: np.ndarray, a: int, b: int) -> np.ndarray:
        x = ((value + b) % PRIME) * a % PRIME
        x = (x ^ (x >> 15)) % PRIME * a % PRIME
        return (x >> 7) & ((1 << self.half) - 1)

    def _pass(self, value: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
        left, right = value >> self.half, value & ((1 << self.half) - 1)
        for a, b in keys:
            left, right = right, left ^ self._mix(right, a, b)
        return (left << self.half) | right

    def _walk(self, rows: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(rows, dtype=np.int64))
        while (outside := out >= self.n).any():
            out[outside] = step(out[outside])
        return out

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Places of the given row numbers."""
        keys = round_keys(self.seed, self.rounds)
        return self._walk(rows, lambda v: self._pass(v, keys))

    def row(self, places: np.ndarray) -> np.ndarray:
        """The inverse: which row number stands at a place."""
        keys = round_keys(self.seed, self.rounds)[::-1]
        mask = (1 << self.half) - 1

        def back(value: np.ndarray) -> np.ndarray:
            left, right = value >> self.half, value & mask
            for a, b in keys:
                left, right = right ^ self._mix(left, a, b), left
            return (left << self.half) | right

        return self._walk(places, back)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, computed alone."""
    place = int(Permutation(n, seed).place(np.array([row]))[0])
    return place % shards, place // shards


def shard_rows(df: DataFrame, order: list[str], shards: int = 24, seed: int = 0, carry: list[str] | None = None) -> DataFrame:
    """Give each row its ``row_number``, ``shard`` and ``slot``.

    ``order`` names the columns whose order fixes the row numbers; rows that
    agree on all of them and on the carried columns are interchangeable. Nulls
    sort first. ``carry`` (all columns by default) limits what moves through the
    sort. An empty table gives an empty result. Columns of ``df`` named like the
    results are replaced.
    """
    ship(df.sparkSession)
    kept = [c for c in (carry or df.columns) if c not in ("row_number", "shard", "slot")]
    named = df.select(*[F.col(f"`{c}`") for c in kept])
    rows, n = numbered(named, [F.col(f"`{c}`").asc_nulls_first() for c in order], "row_number")
    permutation = Permutation(n, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permutation.place(batch.column("row_number").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                names=[*batch.schema.names, "shard", "slot"],
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return rows.mapInArrow(assign, schema)


def documents_to_shards(documents: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Place documents: their size, checksum, shard and slot, by the law ``rows``.

    A null text has no bytes. Null and repeated ids are numbered like others;
    only id, size and checksum move through the sort, never the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = shard_rows(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
