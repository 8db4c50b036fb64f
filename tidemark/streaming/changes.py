"""Ordered change batches applied to base tables and to everything cached from them.

A batch has ``op`` (I, U, D, T), ``lsn``, the table's columns and, for updates
that move a key, the key's former values as ``old_<key>``; ``unchanged`` may name
columns that an update didn't send. A batch is reduced to the last event of each
key before it is applied, and events at or before the last applied position are
skipped, so a batch may safely come twice. Applying one writes the net changes
beside the rows, not the rows anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.cache.engine import Engine, Entry, State
from tidemark.cache.store import Snapshot, Store
from tidemark.functions.rows import admits, admitted
from tidemark.operators.changes import changed_columns, completed, net_changes, without_key
from tidemark.reason import analysis
from tidemark.reason.analysis import Source, Use
from tidemark.reason.spec import Same


def _some(df: DataFrame) -> bool:
    return not df.isEmpty()


def must_invalidate(entry: Entry, use: Use, net: DataFrame, columns: list[str], key: list[str]) -> bool:
    """The invalidation matrix: what a change to this use of a table does to the query."""
    ranges = {c: r for c, r in analysis.constraints(use.branch).of(use.label).items() if c in columns}
    held = entry.kept[use.table].frame
    deletes = net.where("op = 'D'")
    relevant = net.where("op <> 'D'").where(admits(ranges))
    touched = net.join(held.select(*key), key, "left_semi")
    if entry.held is not None and (_some(relevant) or _some(touched)):
        return True
    simple = not use.branch.joins and not use.branch.derived
    match use.source:
        case Source.TERMINAL:
            return False
        case Source.FROM if simple:
            return False
        case Source.FROM:
            joined = {c.partition(".")[2] or c for j in use.branch.joins for x in j.on if isinstance(x, Same) for c in (x.left, x.right) if c.partition(".")[0] == use.label or "." not in c}
            stays = changed_columns(held, relevant, key).where(~F.arrays_overlap("changed", F.array(*[F.lit(c) for c in joined] or [F.lit("")])))
            return _some(relevant.join(stays.select(*key), key, "left_anti"))
        case Source.INCLUSION:
            return _some(relevant)
        case Source.EXCLUSION:
            return _some(deletes.where(admits(ranges))) or _some(touched) or (not simple and _some(relevant))
        case Source.SCALAR:
            return _some(relevant) or _some(touched)
        case _:
            return _some(relevant) or _some(touched)


def apply_changes(engine: Engine, table: str, batch: DataFrame) -> None:
    """Apply one table's batch to the base table and to every cached query that uses it.

    A table without a key takes inserts and deletes of whole rows; what was
    cached from it is loaded anew.
    """
    columns, key = engine.base[table].columns, engine.keys[table]
    batch = batch.where(F.col("lsn") > engine.applied.get(table, -(2**62)))
    top, cut, updates = batch.agg(F.max("lsn"), F.max(F.when(F.col("op") == "T", F.col("lsn"))), F.count(F.when(F.col("op") == "U", 1))).first()
    if top is None:
        return
    if not key and updates:
        raise ValueError(f"{table} has no key, so an update doesn't say which row it changes")
    version: Snapshot = engine.versions[table]
    if cut is not None:
        batch = batch.where(F.col("lsn") > cut)
    if not key:
        rows = version.frame.limit(0) if cut is not None else version.frame
        engine.versions[table], net, net_path = version.replaced(without_key(rows, batch)), None, None
    else:
        net = net_changes(batch, columns, key)
        if "unchanged" in net.columns:
            net = completed(net, version.frame if cut is None else version.frame.limit(0), key)
        net, net_path = engine.store.put(net)
        engine.versions[table] = version.changed(net) if cut is None else version.replaced(net.where("op <> 'D'").select(*columns))
    engine.base[table] = engine.versions[table].frame
    engine.applied[table] = top
    for entry in list(engine.entries.values()):
        if entry.state is not State.READY or table not in entry.kept:
            continue
        entry.result_fresh = False
        used = [u for u in analysis.uses(entry.spec) if u.table == table]
        if net is None or cut is not None or entry.borrowed or any(must_invalidate(entry, u, net, columns, key) for u in used):
            engine.invalidate(entry)
        else:
            entry.kept[table] = entry.kept[table].changed(net, admitted(entry.spec, table, columns))
    if net_path:
        engine.store.drop(net_path)


class Transactions:
    """Changelog rows of transactions that are not yet complete, kept between micro-batches.

    Rows carry ``txn``; an event of op C says that its transaction is whole.
    Rows without ``txn`` are whole by themselves.
    """

    def __init__(self, engine: Engine):
        self.store, self.held, self.path = engine.store, None, None

    def whole(self, batch: DataFrame) -> DataFrame:
        """The rows, of this batch and those before, of all transactions whose end has come."""
        if "txn" not in batch.columns:
            return batch
        rows = batch if self.held is None else self.held.unionByName(batch)
        rows, path = self.store.put(rows)
        ended = rows.where("op = 'C'").select("txn").distinct()
        waiting, before = rows.where("txn IS NOT NULL").join(ended, "txn", "left_anti").select(*rows.columns), self.path
        self.held, self.path = self.store.put(waiting)
        if before:
            self.store.drop(before)
        self._read = path
        return rows.where("op <> 'C' AND txn IS NULL").unionByName(rows.where("op <> 'C'").join(ended, "txn", "left_semi").select(*rows.columns))

    def done(self) -> None:
        """The rows that ``whole`` gave have been applied."""
        if path := getattr(self, "_read", None):
            self.store.drop(path)
            self._read = None


def follow(engine: Engine, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Apply a changelog stream: micro-batches with a ``table`` column and the row as JSON in ``row``.

    Tables that nothing was registered for are ignored. Where rows carry
    ``txn``, a transaction is applied when its end has come. The driver applies
    one batch at a time; a batch that is delivered again changes nothing.
    """
    transactions = Transactions(engine)

    def apply(batch: DataFrame, _: int) -> None:
        batch = transactions.whole(batch)
        for name in [r[0] for r in batch.where(F.col("table").isin(*engine.base)).select("table").distinct().collect()]:
            schema = engine.base[name].schema
            key = ", ".join(f"old_{k} {schema[k].dataType.simpleString()}" for k in engine.keys[name])
            rows = batch.where(F.col("table") == name).select("op", "lsn", F.from_json("row", schema).alias("r"), *([F.from_json("key", key).alias("k")] if key else []))
            apply_changes(engine, name, rows.select("op", "lsn", "r.*", *(["k.*"] if key else [])))
        transactions.done()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_key(spark: SparkSession, source: str, schema, key: str, order: list[str], checkpoint: str) -> DataFrame:
    """Last write per key over a stream of rows, held as a snapshot and the net changes since.

    A micro-batch that brings an older row of a key doesn't replace the newer
    one. Rows with a null key are one key's.
    """
    store, held = Store(spark), {}
    columns = [f.name for f in schema.fields]

    def apply(batch: DataFrame, _: int) -> None:
        last = lambda rows: rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"))
        fresh = last(batch).select(F.lit("I").alias("op"), "_key", "r.*")
        if "rows" not in held:
            held["rows"] = Snapshot.of(store, ["_key"], fresh.drop("op"))
            return
        older = held["rows"].frame.join(fresh.select("_key"), "_key", "left_semi").select("_key", *columns)
        newest = last(older.unionByName(fresh.drop("op")).drop("_key")).select(F.lit("I").alias("op"), "_key", "r.*")
        held["rows"] = held["rows"].changed(newest)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return held["rows"].frame.select(*columns) if "rows" in held else spark.createDataFrame([], schema)
