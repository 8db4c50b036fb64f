"""Shared pieces: column hygiene, lineage cuts and distributed row numbers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule: space and the five control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: One or more of them, as Java and RE2 both read it.
SPACE_RUN = r"[\x20\x09-\x0D]+"


#: Rows in an Arrow batch. Texts are long; Spark's own 10,000 rows of them fill a worker's memory.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it installed, and their batches small unless set otherwise."""
    context = spark.sparkContext
    if context.getConf().get(BATCH_SETTING) is None:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the shared checkpoint folder, remembered for ``sweep``.

    The cluster names that folder in ``spark.checkpoint.dir``; a temporary one
    is set only where the setting is absent and all runs on one machine, as in
    tests.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    made_folders(spark).append(path)
    return path


def made_folders(spark: SparkSession) -> list[str]:
    """The folders that operators named in this session's application, but for those they have dropped themselves."""
    context = spark.sparkContext
    if not hasattr(context, "_tidemark_folders"):
        context._tidemark_folders = []
    return context._tidemark_folders


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the folders made from the ``since``-th on: the tables below results that have been read or written out."""
    made = made_folders(spark)
    for path in [p for p in made[since:] if p not in keep]:
        delete(spark, path)
        made.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Intermediate tables in the shared folder, each dropped when its successor is there.

    Those that a lazy result still reads stay until ``sweep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write as Parquet and read back; the table written under this name before is deleted."""
        path = shared_dir(self.spark)
        df.write.parquet(path)
        self.drop(name)
        self.held[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in tuple(names):
            if path := self.held.pop(name, None):
                delete(self.spark, path)
                made_folders(self.spark).remove(path)


#: A key with over this share of all rows is heavy; there are fewer such keys than its inverse.
HEAVY = 1000


def attach(rows: DataFrame, unique: DataFrame, key: str, count: str) -> DataFrame:
    """Left join ``rows`` to a table with one row per ``key``, safe for heavy keys.

    ``count`` says how many of the rows have each key. Keys with over a
    thousandth of the counted rows are fewer than a thousand, so they are
    broadcast; rows that met one, or have no key, get a salt of their own for
    the shuffled join with the rest, so no task receives a heavy key.
    ``unique`` is read three times: a written table is best.
    """
    names = [c for c in unique.columns if c not in (key, count)]
    total = unique.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    if not total:
        return rows.select("*", *[F.lit(None).cast(unique.schema[c].dataType).alias(c) for c in names])
    pack = F.struct(*names)
    heavy = unique.where(F.col(count) * HEAVY > F.lit(total)).select(F.col(key), pack.alias("_heavy"))
    light = unique.where(F.col(count) * HEAVY <= F.lit(total)).select(F.col(key), F.lit(-1).cast("bigint").alias("_salt"), pack.alias("_light"))
    met = rows.join(F.broadcast(heavy), key, "left")
    met = met.withColumn("_salt", F.when(F.col("_heavy").isNotNull() | F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    found = met.join(light, [key, "_salt"], "left").withColumn("_found", F.coalesce("_heavy", "_light"))
    return found.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in names])


#: Bits of a sieve for each key, its bits at most (8 MB), and the bits that one of Spark's bitmaps holds, 2 to the 15th.
SIEVE_SHARE, SIEVE_BITS, MAP_BITS = 16, 1 << 26, 1 << 15


def may_be_among(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Add boolean ``name``: false only for rows whose ``key``, a bigint, is null or not in ``keys``.

    Each key sets the bit of its hash in bitmaps, which are broadcast. Of the
    other rows about one in ``SIEVE_SHARE`` is true too, more when the keys
    are so many that the bits reach their bound; an exact join must follow. So
    rows that are long but mostly not wanted needn't be shuffled for it.
    ``keys`` is read twice: a written table is best.
    """
    bits = MAP_BITS
    while bits < min(SIEVE_BITS, SIEVE_SHARE * keys.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    places = keys.where(F.col(key).isNotNull()).select(F.shiftright(place, 15).alias("_map"), (place % MAP_BITS).alias("_bit"))
    maps = places.repartition(min(width(rows.sparkSession), bits // MAP_BITS), "_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = place % MAP_BITS
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_map", F.when(F.col(key).isNotNull(), F.shiftright(place, 15))).join(F.broadcast(maps), "_map", "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias(name))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Spark copies a column's expression into filters that it pushes below a
    projection; it doesn't push them below the generator used here.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order, without a global sort in one task.

    Rows are dealt by range and sorted within their partitions; the counts of
    the partitions, one number each, give the offsets. A last key that is
    unique per row keeps any run of equal keys divisible. The numbered rows are
    materialised, so their places can't differ between the two uses.
    Returns the rows with column ``name`` and the number of rows.
    """
    spark = df.sparkSession
    n = max(width(spark), 1)
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie")]
    placed = cut(
        dealt.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    offsets = F.split(F.lit(",".join(map(str, starts)) or "0"), ",").cast("array<bigint>")
    return placed.withColumn(name, F.col("_at") + F.get(offsets, F.col("_part"))).drop("_part", "_at"), total


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree on ``keys``, out of a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
