"""Answers queries from kept source rows or kept results, and keeps both right.

A query's first answer comes from the base tables; the rows it needs of each
table are kept as a snapshot. Later answers re-run the query over the snapshots,
or read its materialised result where its shape makes that worth while. A new
query whose rows are all held by others is answered from theirs.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cache.store import Snapshot, Store
from tidemark.functions.rows import admitted
from tidemark.plans.dialect import Unsupported, names, to_spark
from tidemark.reason import analysis
from tidemark.reason.parse import parse
from tidemark.reason.ranges import Range
from tidemark.reason.spec import Spec, Sub, Table, tables_renamed
from tidemark.sources import arguments, run_over


@dataclass(frozen=True)
class Config:
    """Size limit in bytes (None: none), policy (fifo or clock), admission threshold, allowed tables, the least source rows per result
    row of a materialised result, after how many new queries the hits of those not yet admitted are halved, and the schemas in which
    unqualified names are looked for."""

    cache_size: int | None = None
    policy: str = "clock"
    admission_threshold: int = 1
    allowed_tables: frozenset[str] | None = None
    mv_size_ratio: int = 10
    decay_every: int = 1000
    search_path: tuple[str, ...] = ()


class State(Enum):
    PENDING = "pending"
    LOADING = "loading"
    READY = "ready"
    INVALIDATED = "invalidated"


@dataclass
class Metrics:
    hits: int = 0
    misses: int = 0
    subsumed: int = 0
    invalidations: int = 0
    evictions: int = 0
    populations: int = 0
    materialised: int = 0
    bypassed: int = 0
    failures: int = 0
    latency: list[float] = field(default_factory=list)

    def percentile(self, share: float) -> float:
        ordered = sorted(self.latency)
        return ordered[min(len(ordered) - 1, int(share * len(ordered)))] if ordered else 0.0


@dataclass
class Entry:
    """One cached query."""

    spec: Spec
    fingerprint: str
    generation: int
    state: State = State.PENDING
    kept: dict[str, Snapshot] = field(default_factory=dict)
    borrowed: bool = False
    held: int | None = None
    hits: int = 0
    served: int = 0
    seconds: float = 0.0
    referenced: bool = False
    pinned: bool = False
    result: DataFrame | None = None
    result_path: str | None = None
    result_fresh: bool = False
    result_refused: bool = False
    done: threading.Event = field(default_factory=threading.Event)

    @property
    def rows(self) -> dict[str, DataFrame]:
        return {name: snapshot.frame for name, snapshot in self.kept.items()}


class Engine:
    """A cache over base tables with known primary keys."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]], config: Config = Config()):
        self.spark, self.base, self.keys, self.config = spark, dict(tables), keys, config
        self.store, self.entries, self.metrics = Store(spark), {}, Metrics()
        self.versions = {name: Snapshot(self.store, tuple(keys.get(name, [])), frame) for name, frame in tables.items()}
        self._plain: dict[str, dict[str, Entry]] = {}
        self._admitted = 0
        self.applied: dict[str, int] = {}
        self.connected = True
        self._generation = 0
        self._lock = threading.RLock()

    # answering

    def query(self, spec: Spec) -> DataFrame:
        """The result of a query, from the cache where it may come from there."""
        began = time.monotonic()
        spec = self._resolved(spec)
        try:
            return self._query(spec)
        finally:
            passed = time.monotonic() - began
            self.metrics.latency.append(passed)
            if entry := self.entries.get(analysis.fingerprint(spec)):
                entry.served += 1
                entry.seconds += passed

    def sql(self, text: str, params: list | None = None) -> DataFrame:
        """The result of a SELECT in PostgreSQL's spelling; what a spec can't hold runs on the base tables."""
        try:
            spec = parse(text, params)
        except Unsupported:
            self.metrics.bypassed += 1
            frames = {n: f for n in names(text) if (f := self.base.get(self._table(n))) is not None}
            return self._text(text, frames, arguments(params))
        return self.query(spec)

    def _table(self, name: str) -> str:
        """The base table that a name means: itself, or the first on the search path."""
        return next((full for full in (*[f"{schema}__{name}" for schema in self.config.search_path], name) if full in self.base), name)

    def _resolved(self, spec: Spec) -> Spec:
        return tables_renamed(spec, self._table) if self.config.search_path else spec

    def _query(self, spec: Spec) -> DataFrame:
        if not self.connected or not self._allowed(spec) or analysis.uncacheable(spec):
            self.metrics.bypassed += 1
            return self._run(spec, self.base)
        print_ = analysis.fingerprint(spec)
        with self._lock:
            entry = self.entries.get(print_)
            if entry and entry.state is State.READY and analysis.enough(entry.held, analysis.row_need(spec)):
                self.metrics.hits += 1
                entry.hits += 1
                entry.referenced = True
                return self._serve(entry, spec)
            owner = entry is None or entry.state is not State.LOADING
            if owner:
                entry = self._admit(spec, print_, entry)
        if entry is None:
            self.metrics.misses += 1
            return self._run(spec, self.base)
        if not owner:
            entry.done.wait()
            return self._query(spec) if entry.state is State.READY else self._run(spec, self.base)
        try:
            self._load(entry, spec)
        except Exception:
            # A load that fails leaves nothing behind, and the base tables answer; an error of the query itself comes up again there.
            self.metrics.failures += 1
            with self._lock:
                self._remove(entry)
            entry.done.set()
            return self._run(spec, self.base)
        entry.done.set()
        return self._serve(entry, spec)

    def _admit(self, spec: Spec, print_: str, entry: Entry | None) -> Entry | None:
        """The entry to load now, or none if the query has not been asked for often enough."""
        if entry is None:
            self._generation += 1
            entry = self.entries[print_] = Entry(spec, print_, self._generation)
            self._admitted += 1
            if self._admitted % max(1, self.config.decay_every) == 0:
                for waiting in [e for e in self.entries.values() if e.state is State.PENDING and e is not entry]:
                    waiting.hits //= 2
                    if not waiting.hits:
                        del self.entries[waiting.fingerprint]
        entry.hits += 1
        if entry.state is State.PENDING and self.config.policy == "clock" and entry.hits < self.config.admission_threshold:
            return None
        entry.state = State.LOADING
        entry.done.clear()
        return entry

    def _allowed(self, spec: Spec) -> bool:
        allowed = self.config.allowed_tables
        return allowed is None or all(t in allowed or t.rpartition("_")[2] in allowed for t in spec.relations())

    def _run(self, spec: Spec, frames: dict[str, DataFrame], limited: bool = True) -> DataFrame:
        return self._text(spec.sql(limited), {name: frames[name] for name in spec.relations()})

    def _text(self, text: str, frames: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
        """One SELECT in PostgreSQL's spelling over the named frames."""
        run = lambda spark_sql: run_over(self.spark, frames, spark_sql, args)
        return run(to_spark(text, run))

    # loading

    def _load(self, entry: Entry, spec: Spec) -> None:
        need = analysis.row_need(spec) if all(self.keys.get(name) for name in spec.relations()) else None
        covering = self._covering(spec) if entry.held is None and not entry.kept else None
        if covering:
            self.metrics.subsumed += 1
            kept = {name: e.kept[name] for name, e in covering.items()}
        else:
            self.metrics.misses += 1
            self.metrics.populations += 1
            kept = self._populate(spec, need)
        with self._lock:
            old = [] if entry.borrowed else list(entry.kept.values())
            entry.spec, entry.kept, entry.borrowed = spec, kept, bool(covering)
            entry.held = None if covering else need
            entry.state, entry.result_fresh = State.READY, False
            plain = entry.held is None and not (spec.joins or spec.union or spec.inner())
            if plain and not covering:
                self._plain.setdefault(spec.table.name, {})[entry.fingerprint] = entry
        for snapshot in old:
            self._forget(snapshot)
        self._evict(entry)

    def _populate(self, spec: Spec, need: int | None) -> dict[str, Snapshot]:
        """The rows that each table gives to each branch, once per key and without the padding of outer joins.

        A limited window is taken in the query's own order. Inner branches drop
        conditions on tables of the outer query. Rows of a table without a key
        can't be told apart, so all that its own conditions admit are kept, as
        often as they occur.
        """
        parts: dict[str, list[DataFrame]] = {}
        for branch in spec.branches():
            own = tuple(c for c in branch.where if not self._outer(c, branch))
            kept = branch if branch.table is spec.table and len(own) == len(branch.where) else replace(branch, where=own)
            for t in branch.tables():
                if t.query or not self.keys.get(t.name):
                    continue
                text = f"SELECT DISTINCT {t.label}.* FROM {kept.source()}{kept.filter()}"
                if need is not None:
                    order = ", ".join(f"{c} DESC" if falling else c for c, falling in spec.order) or ", ".join(self.keys[t.name])
                    text = f"SELECT {t.label}.* FROM {kept.source()}{kept.filter()} ORDER BY {order} LIMIT {need}"
                found = self._text(text, {name: self.base[name] for name in kept.relations()})
                if branch.joins:
                    found = found.where(" AND ".join(f"{k} IS NOT NULL" for k in self.keys[t.name]))
                parts.setdefault(t.name, []).append(found)
        out = {}
        for name, found in parts.items():
            frame = found[0]
            for more in found[1:]:
                frame = frame.unionByName(more)
            out[name] = Snapshot.of(self.store, self.keys[name], frame.distinct() if len(found) > 1 else frame)
        for name in spec.relations() - set(parts):
            out[name] = Snapshot.of(self.store, [], self.base[name].where(admitted(spec, name, self.base[name].columns)))
        return out

    def _outer(self, condition, branch: Spec) -> bool:
        """Whether a condition names a column of a table outside the branch."""
        if isinstance(condition, Sub):
            return False
        labels = {t.label for t in branch.tables()}
        known = {c for t in branch.tables() for c in self._columns(t)}
        named = [c for c in (getattr(condition, a, "") or "" for a in ("column", "left", "right")) if c]
        return any(c.partition(".")[0] not in labels if "." in c else c not in known for c in named)

    def _columns(self, table: Table) -> list[str]:
        if not table.query:
            return self.base[table.name].columns
        out: list[str] = []
        for item in table.query.items:
            owner, _, name = item.text.rpartition(".")
            out += [c for t in table.query.tables() if owner in ("", t.label) for c in self._columns(t)] if name == "*" else [item.name]
        return [*table.columns, *out[len(table.columns) :]]

    def _covering(self, spec: Spec) -> dict[str, Entry] | None:
        """For each table a ready, unlimited one-table query that holds all rows wanted of it."""
        if spec.union or spec.inner() or any(j.kind not in ("inner", "cross") for j in spec.joins):
            return None
        wanted, out = analysis.constraints(spec), {}
        if len({t.name for t in spec.tables()}) != len(spec.tables()):
            return None
        for t in spec.tables():
            for e in list(self._plain.get(t.name, {}).values()):
                if e.state is not State.READY or e.borrowed or t.name not in e.kept:
                    continue
                held = analysis.constraints(e.spec)
                if analysis.table_covered(held.of(e.spec.table.label), held.complete, self._own(wanted.of(t.label), t)):
                    out[t.name] = e
                    break
            else:
                return None
        return out

    def _own(self, ranges: dict[str, Range], table: Table) -> dict[str, Range]:
        return {c: r for c, r in ranges.items() if c in self.base[table.name].columns}

    # serving

    def _serve(self, entry: Entry, spec: Spec) -> DataFrame:
        kind = analysis.shape(spec)
        if kind == "skip" or entry.result_refused:
            return self._run(spec, entry.rows)
        if not entry.result_fresh:
            self._materialise(entry, spec, kind)
        if entry.result is None:
            return self._run(spec, entry.rows)
        self.metrics.materialised += 1
        out = entry.result
        if spec.order:
            out = out.orderBy(*[F.col(c).desc_nulls_first() if falling else F.col(c).asc_nulls_last() for c, falling in spec.order])
        if spec.offset:
            out = out.offset(spec.offset)
        return out if spec.limit is None else out.limit(spec.limit)

    def _materialise(self, entry: Entry, spec: Spec, kind: str) -> None:
        """Write the whole result to a new snapshot and point the entry to it, if its shape or size is worth it."""
        bare = replace(spec, order=(), limit=None, offset=None)
        result, path, rows = self.store.counted(self._run(bare, entry.rows))
        if kind == "measure":
            sources = sum(snapshot.rows or 0 for snapshot in entry.kept.values())
            if rows * self.config.mv_size_ratio > sources:
                self.store.drop(path)
                entry.result_refused, entry.result = True, None
                return
        old = entry.result_path
        entry.result, entry.result_path, entry.result_fresh = result, path, True
        if old:
            self.store.drop(old)

    # leaving

    def pin(self, spec: Spec) -> None:
        """Keep a query for good, loaded at once and again whenever it is invalidated."""
        self.query(spec)
        self.entries[analysis.fingerprint(spec)].pinned = True

    def pin_table(self, name: str) -> None:
        self.pin(Spec(Table(name)))

    def invalidate(self, entry: Entry) -> None:
        """Pinned queries load again, the clock keeps the entry for a later load, first-in-first-out drops it."""
        self.metrics.invalidations += 1
        if entry.pinned:
            entry.state = State.LOADING
            self._load(entry, entry.spec)
        elif self.config.policy == "clock":
            entry.state, entry.result_fresh = State.INVALIDATED, False
        else:
            self._remove(entry)

    def _forget(self, snapshot: Snapshot) -> None:
        if not any(snapshot is s for e in self.entries.values() for s in e.kept.values()):
            snapshot.drop()

    def _remove(self, entry: Entry) -> None:
        """Take an entry out, with those that live on its rows, and drop its files."""
        self.entries.pop(entry.fingerprint, None)
        for plain in self._plain.values():
            plain.pop(entry.fingerprint, None)
        entry.state = State.INVALIDATED
        if not entry.borrowed:
            for user in [e for e in self.entries.values() if e.borrowed and any(s is own for s in e.kept.values() for own in entry.kept.values())]:
                self._remove(user)
            for snapshot in entry.kept.values():
                snapshot.drop()
        if entry.result_path:
            self.store.drop(entry.result_path)
            entry.result_path = entry.result = None

    def alter_table(self, name: str, frame: DataFrame, key: list[str] | None = None) -> None:
        """Another schema, or other rows, for a base table: whatever was cached from it goes, pinned queries load again."""
        with self._lock:
            self.base[name], self.keys[name] = frame, self.keys.get(name, []) if key is None else key
            self.versions[name] = Snapshot(self.store, tuple(self.keys[name]), frame)
            for entry in [e for e in self.entries.values() if name in e.spec.relations()]:
                if entry.fingerprint in self.entries:
                    self._remove(entry)
                    self.metrics.invalidations += 1
                    if entry.pinned:
                        self.pin(entry.spec)

    def size(self) -> int:
        results = sum(self.store.size(e.result_path) for e in self.entries.values() if e.result_path)
        return results + sum(s.size() for e in self.entries.values() if not e.borrowed for s in e.kept.values())

    def _evict(self, fresh: Entry) -> None:
        """Oldest first while over the size limit; the clock gives referenced entries a second turn, five a round."""
        if self.config.cache_size is None:
            return
        spared = 0
        while self.size() > self.config.cache_size:
            order = sorted((e for e in self.entries.values() if e is not fresh and e.kept and not e.borrowed), key=lambda e: e.generation)
            victim = next((e for e in order if not e.pinned), None)
            if victim is None:
                return
            if self.config.policy == "clock" and victim.referenced and spared < 5:
                spared += 1
                self._generation += 1
                victim.referenced, victim.generation = False, self._generation
                continue
            self._remove(victim)
            self.metrics.evictions += 1

    def configure(self, **changes) -> None:
        """Change settings while running."""
        self.config = replace(self.config, **changes)

    def status(self) -> DataFrame:
        """One row per cached query."""
        rows = [
            (e.fingerprint, e.state.value, e.hits, e.generation, e.pinned, e.held, e.result_fresh, e.served, e.seconds / e.served if e.served else None, sum(s.rows or 0 for s in e.kept.values()), analysis.complexity(e.spec))
            for e in self.entries.values()
        ]
        names = "fingerprint string, state string, hits int, generation int, pinned boolean, held int, result_fresh boolean"
        return self.spark.createDataFrame(rows, f"{names}, served int, mean_seconds double, rows long, complexity int")
