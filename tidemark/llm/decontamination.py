"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lowered: in
UTF-8, digits, letters and every byte from 0x80 on. Normalised text is the
words with one space before, between and after them, so an item's window of
consecutive words is a plain substring that starts and ends at word borders.
All windows of all items go into one automaton; each text is scanned once, and
a match's end is turned into a word number and, through the words' own places,
into offsets of the original text.

The benchmark is read in blocks of bounded size, each with its own automaton;
one block is the usual case. With more, the documents pass once per block and
carry their hits along, so no benchmark is too large and the result is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import cut, ship

WINDOW = 13
#: Word bytes stay, A-Z is lowered, everything else becomes a space.
TABLE = bytes(b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b >= 0x80 else b + 32 if b in range(0x41, 0x5B) else 0x20 for b in range(256))
#: A block of items holds at most so many bytes of windows.
BLOCK_BYTES = 16_000_000


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """All runs of ``size`` words; a shorter item, unless empty, is one window."""
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


_built: dict[str, object] = {}


def automaton(block: list[tuple[str, str | None]], size: int, key: str):
    """The automaton of a block's items: a match gives (word count, items). One is kept in each Python worker."""
    if key not in _built:
        import ahocorasick

        found: dict[str, tuple[int, set[str]]] = {}
        for item, text in block:
            for window in windows(normalised(text), size):
                found.setdefault((b" " + b" ".join(window) + b" ").decode("latin-1"), (len(window), set()))[1].add(item)
        machine = ahocorasick.Automaton()
        for pattern, (n, items) in found.items():
            machine.add_word(pattern, (n, tuple(sorted(items))))
        machine.make_automaton()
        _built.clear()
        _built[key] = machine
    return _built[key]


def scan(words: list[bytes], machine) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence of a window, and the items these belong to."""
    hit, items = np.zeros(len(words), dtype=bool), set()
    if not words or not len(machine):
        return hit, items
    ends: np.ndarray | None = None
    for at, (n, names) in machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        if ends is None:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = int(np.searchsorted(ends, at))
        hit[last - n + 1 : last + 1] = True
        items.update(names)
    return hit, items


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last-but-one word of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


#: The same words in the original text, where A-Z still stands.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def spans_of(text: str, word_runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of runs of word numbers."""
    if not word_runs:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in word_runs]


def item_blocks(benchmark: DataFrame, size: int, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks whose windows hold at most ``limit`` bytes, or one item if that alone holds more."""
    block, held = [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in items.toLocalIterator():
        cost = len((row["text"] or "").encode("utf-8", "surrogatepass")) * size
        if block and held + cost > limit:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += cost
    yield block


def find_contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hit words, items and original spans of every document.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items,
    spans (code points, end exclusive) and longest, the number of words of the
    longest run of hit words. A null text has no words and is not
    contaminated; null or empty items have no window; an item without an id is
    named by the empty string; items that share an id count once. No row is
    moved: the scan needs no shuffle.
    """
    return _scanned(documents, benchmark, size, block_bytes, [])


def clean_documents(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that repeat nothing of the benchmark, with their own columns; nothing is joined or moved.

    A document goes if it holds ``size`` benchmark words in a row, however long
    it is, or if it is contaminated by its share of hit words. Items of fewer
    words may stand in a long text by chance; they count by their share alone.
    Null and empty texts stay, as do rows without a doc_id that are clean;
    repeated rows are judged alike. Extra columns are carried along whatever
    their names, and an empty table gives an empty result.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_own")
    clean = ~F.col("contaminated") & (F.col("longest") < size)
    return _scanned(documents, benchmark, size, block_bytes, [own]).where(clean).select("_own.*")


def _scanned(documents: DataFrame, benchmark: DataFrame, size: int, block_bytes: int, carried: list) -> DataFrame:
    ship(documents.sparkSession)
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    names = narrow.columns[2:]
    state = narrow.withColumn("_runs", F.lit(None).cast("array<bigint>")).withColumn("_items", F.lit(None).cast("array<string>"))
    state = state.select("doc_id", "text", "_runs", "_items", *names)
    blocks = item_blocks(benchmark, size, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        state = _pass(state, block, size, last=following is None)
        if following is not None:
            state = cut(state)
        block = following
    return state


def _pass(state: DataFrame, block: list[tuple[str, str | None]], size: int, last: bool) -> DataFrame:
    key = hashlib.sha256(repr((size, block)).encode("utf-8", "surrogatepass")).hexdigest()
    shared = state.sparkSession.sparkContext.broadcast(block)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value, size, key)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, earlier, names in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                words = normalised(text)
                hit, items = scan(words, machine)
                items.update(names or ())
                for a, b in zip((earlier or [])[::2], (earlier or [])[1::2], strict=True):
                    hit[a:b] = True
                if not last:
                    out.append((doc_id, text, [x for run in runs(hit) for x in run], sorted(items)))
                    continue
                n_hit, named = int(hit.sum()), sorted(items)
                digest = hashlib.sha256(",".join(named).encode("utf-8")).hexdigest()
                found = runs(hit)
                spans = [{"start": a, "end": b} for a, b in spans_of(text or "", found)]
                longest = max((b - a for a, b in found), default=0)
                out.append((doc_id, len(words), n_hit, len(named), digest, n_hit > 0 and 20 * n_hit >= len(words), named, spans, longest))
            schema = RESULT if last else STATE
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            made = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[4:]], names=[*schema.names, *batch.schema.names[4:]])

    made = StructType.fromDDL(RESULT_DDL if last else STATE_DDL).fields
    return state.mapInArrow(mark, StructType([*made, *state.schema.fields[4:]]))


STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("_runs", pa.list_(pa.int64())), ("_items", pa.list_(pa.string()))])
STATE_DDL = "doc_id bigint, text string, _runs array<bigint>, _items array<string>"
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
    + [("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("longest", pa.int64())]
)
RESULT_DDL = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:bigint,end:bigint>>, longest bigint"
