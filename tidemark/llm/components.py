"""Connected components of a link table: of few links in one task, of more by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Tables

#: So many links are few: one task holds them in some megabytes. A round of stars takes four tables, whatever it holds.
FEW = 1 << 17
#: Kinds of nodes that Arrow orders as Spark does.
PLAIN = (T.BinaryType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low"))


def _in_one_task(links: DataFrame) -> DataFrame:
    """node, root of links a, b that one task can hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        nodes = pc.unique(pa.chunked_array([*table["a"].chunks, *table["b"].chunks]))
        nodes = nodes.take(pc.array_sort_indices(nodes))
        a, b = (pc.index_in(table[c], value_set=nodes).to_numpy() for c in ("a", "b"))
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            for side in (a, b):
                np.minimum.at(root, root[side], low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["node", "root"])

    kind = links.schema["a"].dataType
    return links.repartition(1).mapInArrow(work, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))


def components(links: DataFrame) -> DataFrame:
    """The lowest node reachable from each linked node.

    ``links`` has columns a and b of one orderable type; loops and repeats are
    harmless, nodes without a link are absent from the result (node, root).
    It is read twice: a written table is best. At most ``FEW`` links are solved
    in one task, as rounds over a small table cost their stages and no more.
    For more of them, each half round moves links between neighbours of one
    node; minima are found by partial aggregation and joined back as a written
    table, so that a node with very many links is a skewed join that Spark can
    split. Nothing is collected but the number of links and two numbers a round.
    The round tables are dropped as it goes.
    """
    links = links.select("a", "b").where("a <> b")
    if isinstance(links.schema["a"].dataType, PLAIN) and links.schema["a"].dataType == links.schema["b"].dataType and links.count() <= FEW:
        return _in_one_task(links)
    tables = Tables(links.sparkSession)
    pair = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = tables.put("edges", links.select(pair.alias("p")).select("p.*").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tables.put("low", _lowest(both))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).where("u <> v").distinct()
        edges = tables.put("large", large)
        low = tables.put("low", _lowest(edges))
        joined = edges.join(low, "u")
        small = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        edges = tables.put("edges", small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    tables.drop("low", "large")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
