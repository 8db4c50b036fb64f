"""Near-duplicate groups by MinHash bands, odd sketches and an exact check.

1. Each document's set of word shingles is hashed; documents with the same set
   collapse into one node.
2. A node's MinHash samples give band keys and an odd sketch: the samples
   folded into a bitmap of parities. The number of ones in the XOR of two
   bitmaps counts the samples in which the sets differ, most precisely where
   they are much alike. Within a band bucket, pairs whose count lies within
   reach of the threshold are joined into trees, and trees into clusters.
3. Texts of clustered nodes only are gathered by cluster, and every pair within
   a cluster is held against the threshold on the full sets. Other texts are
   sieved out where they are read, but for a few, so they aren't shuffled.

Buckets and clusters over a block's size are split into chunks, so no task holds
more than two chunks of one. First every chunk is compared within itself and
with one pivot of its group. Members that are thereby connected with the pivot
are connected with each other, and their pairs need no look; every other member
is then compared with all chunks. So a group of copies of one text costs work in
proportion to its size, and no pair that could connect anything is left out. A
block returns a spanning tree of what it links, not its pairs. With
the default samples and bands a link of exactly the threshold is missed with a
probability under one in a million; links of higher similarity with less.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Tables, attach, by_group, may_be_among, ship, width
from tidemark.llm.components import components

SAMPLES = 256
BITS = 512
ROWS = 4
#: A task holds two chunks at most: of sketches, and of texts.
SKETCH_CHUNK = 1024
TEXT_CHUNK = 256
#: A spanning tree has so many children per node, which bounds the links of one node.
FAN = 16


@dataclass(frozen=True)
class Rule:
    """Shingle length and the least share of common shingles, ``percent`` of the union."""

    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        """Bands that miss a pair of just this similarity with under one chance in 2.5 million."""
        return math.ceil(math.log(4e-7) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def least(self) -> int:
        """Two different sets can't be linked below this size: sharing n-1 of n must be enough."""
        return math.floor(self.percent / (100 - self.percent)) if self.percent < 100 else 1 << 62

    @property
    def limit(self) -> int:
        """The largest XOR count that a linked pair shows but for one case in many millions."""
        return _limit(self.percent)


@functools.cache
def _limit(percent: int) -> int:
    rng = np.random.default_rng(7)
    differ = rng.binomial(SAMPLES, 1 - percent / 100, size=20_000)
    ones = np.array([int((np.bincount(rng.integers(0, BITS, 2 * d), minlength=BITS) & 1).sum()) for d in differ])
    return math.ceil(ones.mean() + 5.5 * ones.std())


_MIX = np.random.default_rng(11).integers(1 << 62, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_PERMUTE = np.random.default_rng(13).integers(0, 1 << 32, size=SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_FOLD = np.random.default_rng(17).integers(0, 1 << 32, size=(2, SAMPLES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The text's set as sorted 64-bit hashes: A-Z lowered, runs of ``words`` words, a shorter text as one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(found))
    n = len(found) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out + hashes[i : i + n]) * _MIX[i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(members: np.ndarray, rule: Rule) -> tuple[list[int], bytes]:
    """Band keys and odd sketch of a set."""
    lanes = (members >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(lanes), 2048):
        np.minimum(low, (_PERMUTE[:, None] * lanes[None, at : at + 2048]).min(axis=1), out=low)
    keys = [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - (1 << 63) for i in range(rule.bands)]
    folded = (low ^ _FOLD[0]) * _FOLD[1]
    folded ^= folded >> np.uint32(15)
    bits = (folded * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS.bit_length() + 1)
    return keys, np.packbits((np.bincount(bits, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def node_of(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def trees(links: Iterator[tuple[int, np.ndarray]], nodes: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links that connect what the given rows of links connect: a tree of bounded fan per component."""
    label = np.arange(len(nodes))
    for a, others in links:
        for other in np.unique(label[others]):
            if other != label[a]:
                label[label == other] = label[a]
    out = []
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    for group in np.split(order, cuts):
        if len(group) > 1:
            names = sorted({nodes[i] for i in group})
            out.extend((names[(i - 1) // FAN], names[i]) for i in range(1, len(names)))
    return out


def _sketched(documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, node, bands, odd of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                members = shingles(text.as_py(), rule.words)
                keys, odd = sketch(members, rule) if len(members) >= rule.least else (None, None)
                out.append((len(members), node_of(members) if len(members) else None, keys, odd))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_shingles", "node", "bands", "odd"])

    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(work, "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>, odd binary")


def _links_in_groups(members: DataFrame, group: str, chunk_rows: int, compare: Callable[[DataFrame], DataFrame], tables: Tables) -> DataFrame:
    """Links a, b that connect what ``compare`` links within each group of members (columns ``group`` and node).

    ``compare`` takes blocks: members with columns i, j and chunk. Where i = j,
    every pair of the block's rows is to be compared, else the rows of chunk i
    with those of chunk j. Groups of one give no block. Group sizes are joined
    so that the rows of one hot group never meet in one task.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_pivot")).where("_n > 1")
    sizes = tables.put("sizes", sizes.withColumn("_chunks", F.ceil(F.col("_n") / chunk_rows)))
    chunk = F.pmod(F.xxhash64("node"), F.col("_chunks"))
    sized = attach(members, sizes, group, "_n").where("_chunks IS NOT NULL").withColumn("chunk", chunk)
    large = sizes.where("_chunks > 1")
    pivots = large.select(group, F.col("_pivot").alias("node"), "_chunks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)).alias("chunk")).where(F.col("chunk") != chunk)
    blocks = sized.select(group, "node", "chunk").unionByName(pivots.select(group, "node", "chunk"))
    links = tables.put("within", compare(blocks.withColumn("i", F.col("chunk")).withColumn("j", F.col("chunk"))).distinct())
    if large.isEmpty():
        return links
    roots = tables.put("roots", components(links))
    pivot_roots = large.join(roots.withColumnRenamed("node", "_pivot"), "_pivot", "left").select(group, "_n", F.coalesce("root", "_pivot").alias("_at"))
    in_large = sized.where("_chunks > 1").select(group, "node", "chunk", "_chunks").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = attach(in_large, tables.put("pivots", pivot_roots), group, "_n").where("root <> _at").select(group, "node", "_chunks")
    apart = tables.put("apart", apart)
    if apart.isEmpty():
        return links
    left = apart.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_parts"))
    left = tables.put("left", left.join(large.select(group, "_n"), group))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    part = (-1 - F.pmod(F.xxhash64("node"), F.col("_parts"))).alias("i")
    those = attach(apart, left, group, "_n").select(group, "node", part, every("_chunks").alias("j")).withColumn("chunk", F.col("i"))
    others = attach(sized.where("_chunks > 1").select(group, "node", "chunk"), left, group, "_n").where("_parts IS NOT NULL")
    others = others.select(group, "node", "chunk", every("_parts").alias("_part")).select(group, "node", (-1 - F.col("_part")).alias("i"), F.col("chunk").alias("j"), "chunk")
    across = tables.put("across", compare(those.unionByName(others)).distinct())
    return links.unionByName(across)


def _close_in_sketch(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Links a, b of the trees over pairs of a bucket whose sketches and sizes are within reach."""
    limit, percent = rule.limit, rule.percent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_group(batches, ["band", "i", "j"]):
            nodes = block.column("node").to_pylist()
            bits = np.frombuffer(b"".join(block.column("odd").to_pylist()), np.uint64).reshape(len(nodes), -1)
            size = block.column("n_shingles").to_numpy()
            chunk = block.column("chunk").to_numpy()
            i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()

            def links() -> Iterator[tuple[int, np.ndarray]]:
                for a in range(len(nodes)):
                    others = np.arange(a + 1, len(nodes)) if i == j else np.flatnonzero(chunk == j) if chunk[a] == i else ()
                    if not len(others):
                        continue
                    ones = np.bitwise_count(bits[others] ^ bits[a]).sum(axis=1)
                    fits = 100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a])
                    yield a, others[(ones <= limit) & fits]

            if found := trees(links(), nodes):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    spark = blocks.sparkSession
    dealt = blocks.repartition(width(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(work, "a binary, b binary")


def _linked_in_full(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Links a, b of the trees over pairs of a cluster that meet the threshold on their full sets."""
    words, percent = rule.words, rule.percent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_group(batches, ["cluster", "i", "j"]):
            i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
            nodes, sets, chunk = [], [], []
            for node, text, own in zip(block.column("node").to_pylist(), block.column("text"), block.column("chunk").to_pylist(), strict=True):
                members = shingles(text.as_py(), words)
                if node_of(members) == node:  # else another text with the same doc_id
                    nodes.append(node)
                    sets.append(members)
                    chunk.append(own)
            if len(nodes) < 2:
                continue
            size, side = np.array([len(s) for s in sets]), np.array(chunk)
            vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(size)])

            def links() -> Iterator[tuple[int, np.ndarray]]:
                has = np.zeros(len(vocabulary), np.int32)
                later = np.flatnonzero(side == j)
                for a in range(len(nodes)):
                    if i != j and side[a] != i:
                        continue
                    has[ids[starts[a] : starts[a + 1]]] = 1
                    common = np.add.reduceat(has[ids], starts[:-1])
                    has[ids[starts[a] : starts[a + 1]]] = 0
                    others = np.arange(a + 1, len(nodes)) if i == j else later
                    both = common[others]
                    yield a, others[100 * both >= percent * (size[a] + size[others] - both)]

            if found := trees(links(), nodes):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    spark = blocks.sparkSession
    dealt = blocks.repartition(width(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(work, "a binary, b binary")


def near_duplicates(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    ``component_id`` is the smallest doc_id reachable over links, the document's
    own included; ``kept`` is whether it is the document's own. Texts that are
    null, empty or without words have no shingles and are linked with nothing.
    Rows with a null doc_id are not linked either: null component, kept.
    Repeated rows share set and component. All columns but doc_id and text are
    ignored. An empty table gives an empty result.
    """
    ship(documents.sparkSession)
    found = _placed(documents, rule, Tables(documents.sparkSession))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _placed(documents: DataFrame, rule: Rule, tables: Tables) -> DataFrame:
    """doc_id, n_shingles, node and component_id of every document, and keeper, the node that stays for the component."""
    rows = tables.put("rows", _sketched(documents, rule))
    linkable = rows.where("doc_id IS NOT NULL AND node IS NOT NULL")
    best = F.min(F.struct("doc_id", "n_shingles", "bands", "odd")).alias("top")
    nodes = tables.put("nodes", linkable.groupBy("node").agg(best, F.count(F.lit(1)).alias("copies")).select("node", "copies", "top.*"))

    passing = Tables(documents.sparkSession)
    members = nodes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    sketches = nodes.select("node", "n_shingles", "odd")
    near = _links_in_groups(members, "band", SKETCH_CHUNK, lambda blocks: _close_in_sketch(blocks.join(sketches, "node"), rule), passing)
    places = nodes.select("node", "doc_id")
    clusters = tables.put("clusters", components(near).withColumnRenamed("root", "cluster").join(places, "node"))
    passing.drop(*passing.held)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = may_be_among(texts, clusters, "doc_id", "_wanted").where("_wanted").drop("_wanted")
    places = clusters.select("node", "doc_id")

    def compared(blocks: DataFrame) -> DataFrame:
        return _linked_in_full(blocks.join(places, "node").join(wanted, "doc_id").drop("doc_id"), rule)

    linked = _links_in_groups(clusters, "cluster", TEXT_CHUNK, compared, passing)
    roots = tables.put("components", components(linked))
    passing.drop(*passing.held)
    named = nodes.select("node", "copies", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = tables.put("named", named)
    smallest = named.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("top"), F.count(F.lit(1)).alias("_n"))
    smallest = smallest.select("root", F.col("top.doc_id").alias("component_id"), F.col("top.node").alias("keeper"), "_n")
    placed = attach(named.select("node", "copies", "root"), tables.put("smallest", smallest), "root", "_n").select("node", "copies", "component_id", "keeper")
    found = attach(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), tables.put("placed", placed), "node", "copies")
    component = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    tables.drop("clusters", "nodes", "components", "named", "smallest")
    return found.select("doc_id", "n_shingles", "node", component.alias("component_id"), "keeper")


def _with_node(rows: DataFrame, rule: Rule) -> DataFrame:
    """Add the node of ``_text``, null for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), rule.words) for text in batch.column("_text")]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, "_node"])

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("_node", T.BinaryType())]))


def keep_one(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without their near duplicates: of each group the one with the smallest doc_id stays, once.

    Rows with a null doc_id are not linked and all stay. Rows that share a
    doc_id but not a shingle set are judged one by one: of a group whose
    smallest doc_id they share, the set of the lowest digest stays. Of rows
    with the same doc_id and set, the first in the order of text and then of
    the whole row as JSON stays.
    """
    ship(documents.sparkSession)
    tables = Tables(documents.sparkSession)
    own = F.col("node").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("keeper")))
    found = _placed(documents, rule, tables).where("doc_id IS NOT NULL").withColumn("own", own)
    best = F.struct(F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(best.alias("_of")).select("_id", "_of.*")
    ids = tables.put("ids", ids.where("NOT own OR n > 1"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    rows = may_be_among(rows, ids, "_id", "_asked")
    # Most rows stay where they are read; what the sieve holds back, false hits included, is asked exactly.
    asked = rows.where("_asked").drop("_asked")
    kept = rows.where("NOT _asked").drop("_asked").unionByName(asked.join(ids, "_id", "left_anti")).select("_row.*")
    several = ids.where("own AND n > 1").select("_id")
    if several.isEmpty():
        return kept
    rows = asked.join(several, "_id", "left_semi")
    rows = _with_node(rows.select("_id", F.col("_row.text").cast("string").alias("_text"), "_row"), rule)
    pairs = found.where("own").join(several, F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_set")).distinct()
    rows = rows.join(pairs, (F.col("_id") == F.col("_doc")) & F.col("_node").eqNullSafe(F.col("_set")), "left_semi")
    rows = rows.groupBy("_id", "_node").agg(F.min_by("_row", F.struct("_text", F.to_json("_row"))).alias("_row"))
    return kept.unionByName(rows.select("_row.*"))
