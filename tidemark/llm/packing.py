"""Packing token pieces into fixed-length sequences by exact complements.

All a packer needs to know about a corpus is how many pieces it has of each
length, so the plan is made from that histogram alone: at most ``capacity``
counts, whatever the size of the corpus. The plan is a list of patterns (the
lengths of one sequence) with the number of sequences that use each. A hashed
index holds the sums of one, two and three lengths in stock. The gap that a
length or an opened sequence leaves is looked up in the index, and each
combination that fills it exactly is used as often as the counts allow. What no
combination completes goes by best fit. Pieces are then numbered within their
length, across the cluster, and each looks up its sequence and offset from its
number.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, numbered, ship

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"


@dataclass
class Plan:
    """Patterns with their sequence counts, and for each length where its pieces go."""

    capacity: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: the first piece number of each slot run, its first sequence, its offset."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for lengths, n in self.patterns:
            at = 0
            for length in lengths:
                runs.setdefault(length, []).append((taken.get(length, 0), first, at))
                taken[length] = taken.get(length, 0) + n
                at += length
            first += n
        return {k: tuple(np.array(column, dtype=np.int64) for column in zip(*v, strict=True)) for k, v in runs.items()}


class Sums:
    """The sums, below the capacity, of one, two and three lengths: a hash table from each to its combinations.

    A triple is held as its longest length and the sum of the other two, whose
    pairs the same index gives. Lookups go by the counts of the moment.
    """

    def __init__(self, lengths: Iterable[int], capacity: int):
        stock = sorted((x for x in lengths if x < capacity), reverse=True)
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[tuple[int, int]]] = {}
        for i, a in enumerate(stock):
            for b in stock[i:]:
                if a + b < capacity:
                    self.pairs.setdefault(a + b, []).append((a, b))
        evenest = {total: found[-1][0] for total, found in self.pairs.items()}
        for a in stock:
            for total in range(2, capacity - a):
                if evenest.get(total, a + 1) <= a:
                    self.triples.setdefault(a + total, []).append((a, total))

    def filling(self, gap: int, count: np.ndarray, parts: int, even: bool) -> Iterator[tuple[int, ...]]:
        """Combinations in stock of up to ``parts`` lengths that sum to the gap: fewest first, then the least even or the most."""
        order = reversed if even else iter
        if count[gap]:
            yield (gap,)
        if parts > 1:
            yield from (p for p in order(self.pairs.get(gap, [])) if count[p[0]] and count[p[1]])
        if parts > 2:
            for a, total in order(self.triples.get(gap, [])):
                if count[a]:
                    yield from ((a, *p) for p in order(self.pairs[total]) if p[0] <= a and count[p[0]] and count[p[1]])

    def anchored(self, length: int, gap: int, count: np.ndarray, parts: int, even: bool) -> Iterator[tuple[tuple[int, ...], int]]:
        """Patterns of pieces of one length, which may complete themselves, with what fills their gap; both are taken from the counts."""
        for others in self.filling(gap, count, parts, even):
            pattern = (length, *others)
            n = min(int(count[x]) // pattern.count(x) for x in set(pattern))
            if n:
                for x in pattern:
                    count[x] -= n
                yield pattern, n
            if not count[length]:
                return

    def take(self, begun: tuple[int, ...], most: int, gap: int, count: np.ndarray, parts: int, even: bool) -> Iterator[tuple[tuple[int, ...], int]]:
        """Up to ``most`` sequences of the lengths ``begun`` and what fills their gap, as patterns with counts; the lengths are taken from the counts."""
        for others in self.filling(gap, count, parts, even):
            n = min(most, *(int(count[x]) // others.count(x) for x in set(others)))
            if n:
                for x in others:
                    count[x] -= n
                most -= n
                yield (*begun, *others), n
            if not most:
                return


class Opened:
    """Sequences with a gap, equal ones as one entry."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        self.gaps: list[int] = []

    def put(self, pattern: tuple[int, ...], n: int) -> None:
        gap = self.capacity - sum(pattern)
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            bisect.insort(self.gaps, gap)
        self.by_gap[gap].append((pattern, n))

    def fit(self, length: int, n: int) -> None:
        """Put n pieces where they leave the least gap, or into new sequences."""
        while n:
            at = bisect.bisect_left(self.gaps, length)
            if at == len(self.gaps):
                each = self.capacity // length
                if n >= each:
                    self.put((length,) * each, n // each)
                if n % each:
                    self.put((length,) * (n % each), 1)
                return
            gap = self.gaps[at]
            pattern, free = self.by_gap[gap].pop()
            if not self.by_gap[gap]:
                del self.by_gap[gap]
                self.gaps.pop(at)
            used = min(free, n)
            if used < free:
                self.put(pattern, free - used)
            self.put((*pattern, length), used)
            n -= used

    def complete(self, sums: Sums, count: np.ndarray, even: bool) -> Iterator[tuple[tuple[int, ...], int]]:
        """The sequences whose gaps combinations fill exactly; the others stay open."""
        entries = [(gap, pattern, n) for gap in self.gaps for pattern, n in self.by_gap[gap]]
        self.by_gap, self.gaps = {}, []
        for gap, pattern, n in entries:
            if gap:
                for found in sums.take(pattern, n, gap, count, 3, even):
                    n -= found[1]
                    yield found
            if n:
                self.put(pattern, n)

    def all(self) -> Iterator[tuple[tuple[int, ...], int]]:
        for gap in self.gaps:
            yield from self.by_gap[gap]


#: Orders in which complements are consumed: how many lengths the passes may use, whether the evenest combination of a sum comes
#: first, and the length from which on pieces that single complements leave are opened by best fit before their gaps are looked up.
ORDERS = [(passes, even, None) for passes in ((3,), (1, 2, 3)) for even in (False, True)] + [((1,), even, least) for even in (False, True) for least in (512, 256, 128, 64, 32)]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack the histogram's pieces, exact complements of up to three lengths first, then best fit.

    Which pieces complete which decides what is left in the end, so complements
    are consumed in each of ``ORDERS`` and the plan of the fewest sequences counts.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit in {capacity}")
        count[length] += n
    sums = Sums(np.flatnonzero(count).tolist(), capacity)
    least = -(-int((count * np.arange(capacity + 1)).sum()) // capacity)
    best: Plan | None = None
    for order in ORDERS:
        plan = _plan(count.copy(), sums, capacity, *order)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def _plan(count: np.ndarray, sums: Sums, capacity: int, passes: tuple[int, ...], even: bool, least: int | None) -> Plan:
    plan, opened = Plan(capacity), Opened(capacity)
    if count[capacity]:
        plan.patterns.append(((capacity,), int(count[capacity])))
        count[capacity] = 0
    for parts in passes:
        for length in range(capacity - 1, 0, -1):
            if count[length]:
                plan.patterns.extend(sums.anchored(length, capacity - length, count, parts, even))
    if least is not None:
        for length in range(capacity - 1, min(least, capacity) - 1, -1):
            opened.fit(length, int(count[length]))
            count[length] = 0
        plan.patterns.extend(opened.complete(sums, count, even))
    for length in range(capacity - 1, 0, -1):
        opened.fit(length, int(count[length]))
    plan.patterns.extend(opened.all())
    return plan


_encoders: dict[str, object] = {}


def encoder(name: str = VOCABULARY):
    """Text to ids of a public vocabulary.

    The ids are those of ``tokenizers`` with the vocabulary's JSON file, called
    with ``add_special_tokens=False``. They are computed from the same
    vocabulary's rank file, which is about four times faster; a text that holds
    one of the file's added tokens, or that the rank reader refuses (a run of
    white space beyond its stack), is encoded by ``tokenizers`` itself.
    One encoder is kept in each Python worker.
    """
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = [token.content for token in exact_encoder(name).get_added_tokens_decoder().values()]

        def encode(text: str) -> np.ndarray:
            try:
                if any(token in text for token in added):
                    return np.array(exact_encoder(name).encode(text, add_special_tokens=False).ids, dtype="<u4")
                return np.array(fast.encode_ordinary(text), dtype="<u4")
            except BaseException as error:
                if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
                return np.array(exact_encoder(name).encode(text, add_special_tokens=False).ids, dtype="<u4")

        _encoders[name] = encode
    return _encoders[name]


def exact_encoder(name: str = VOCABULARY):
    """The ``tokenizers`` encoder of the vocabulary's JSON file, as it is read."""
    if (name, "exact") not in _encoders:
        import public_tokenizers
        from tokenizers import Tokenizer

        _encoders[name, "exact"] = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    return _encoders[name, "exact"]


def cut_points(n: int, capacity: int) -> list[int]:
    """Where pieces of a document of n ids start: the first takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32.

    Each text's ids are followed by the end id; a null text is an empty one. A
    document over the capacity is cut into pieces of exactly the capacity, but
    for its first.
    """
    ship(documents.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                starts = cut_points(len(ids), capacity)
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(pieces, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Every row gets a place; rows of equal length are interchangeable to the
    packer and numbered in the order of doc_id and piece (nulls first), rows
    equal in all columns in any order. An empty table gives an empty result.
    """
    ship(pieces.sparkSession)
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(counts, capacity)
    slots = plan.slots()
    first = {}
    for length in sorted(counts):
        first[length] = sum(counts[x] for x in counts if x < length)
    order = [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("piece")]
    rows, _ = numbered(pieces, order, "_row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            row = batch.column("_row").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                starts, sequences, offsets = slots[int(x)]
                rank = row[mine] - first[int(x)]
                run = np.searchsorted(starts, rank, side="right") - 1
                sequence[mine] = sequences[run] + rank - starts[run]
                offset[mine] = offsets[run]
            keep = [i for i, c in enumerate(batch.schema.names) if c != "_row"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)],
                names=[*[batch.schema.names[i] for i in keep], "sequence_id", "offset"],
            )

    fields = [f for f in rows.schema.fields if f.name != "_row"]
    return rows.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    return pack(token_pieces(documents, capacity, vocabulary), capacity)
