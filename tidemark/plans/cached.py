"""Queries answered through the cache, before and after change batches, with the SQL of the right answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cache.engine import Config, Engine
from tidemark.reason.spec import Between, Compare, In, Item, Join, Same, Spec, Sub, Table
from tidemark.sources import TABLES, shared_root, table
from tidemark.streaming.changes import apply_changes, follow, latest_per_key

KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "events": ["event_id"], "lineitem": []}

ORDERS = Spec(Table("orders"), items=(Item("o_orderkey"), Item("o_custkey"), Item("o_totalprice")))
COUNT = Item("count(*)", "n", "aggregate")


def engine(spark: SparkSession, base: str, **config) -> Engine:
    return Engine(spark, {name: table(spark, base, name) for name in TABLES}, KEYS, Config(**config))


def _with(spec: Spec, **changes) -> Spec:
    from dataclasses import replace

    return replace(spec, **changes)


def changes(spark: SparkSession, base: str) -> DataFrame:
    """A batch for orders by rule: of fifty keys one is updated, one deleted, one inserted anew and one moved."""
    orders = table(spark, base, "orders")
    r = F.col("o_orderkey") % 50
    none = F.lit(None).cast("bigint").alias("old_o_orderkey")
    same = [F.col(c) for c in orders.columns if c not in ("o_orderkey", "o_totalprice", "o_custkey")]
    order = orders.columns
    updated = orders.where(r == 0).select(F.lit("U").alias("op"), (F.col("o_orderkey") + 0).alias("lsn"), "o_orderkey", "o_custkey", (450000 - F.col("o_totalprice")).alias("o_totalprice"), *same, none)
    deleted = orders.where(r == 1).select(F.lit("D").alias("op"), F.col("o_orderkey").alias("lsn"), "o_orderkey", "o_custkey", "o_totalprice", *same, none)
    inserted = orders.where(r == 2).select(F.lit("I").alias("op"), F.col("o_orderkey").alias("lsn"), (F.col("o_orderkey") + 10**9).alias("o_orderkey"), "o_custkey", "o_totalprice", *same, none)
    moved = orders.where(r == 3).select(F.lit("U").alias("op"), F.col("o_orderkey").alias("lsn"), (F.col("o_orderkey") + 2 * 10**9).alias("o_orderkey"), "o_custkey", "o_totalprice", *same, F.col("o_orderkey").alias("old_o_orderkey"))
    return updated.unionByName(deleted).unionByName(inserted).unionByName(moved).select("op", "lsn", *order, "old_o_orderkey")


_SAME = "o_orderstatus, o_orderdate, o_orderpriority"
AFTER = f"""orders AS (
SELECT o_orderkey, o_custkey, o_totalprice, {_SAME} FROM main.orders WHERE o_orderkey % 50 NOT IN (0, 1, 3)
UNION ALL SELECT o_orderkey, o_custkey, 450000 - o_totalprice, {_SAME} FROM main.orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice, {_SAME} FROM main.orders WHERE o_orderkey % 50 = 2
UNION ALL SELECT o_orderkey + 2000000000, o_custkey, o_totalprice, {_SAME} FROM main.orders WHERE o_orderkey % 50 = 3)"""

_RANGE = _with(ORDERS, where=(Compare("o_totalprice", ">", 200000), Compare("o_orderstatus", "=", "F")))
_JOIN = Spec(
    Table("orders"),
    (Join("inner", Table("customer"), (Same("orders.o_custkey", "customer.c_custkey"),)),),
    (Compare("orders.o_totalprice", ">", 300000), Compare("customer.c_mktsegment", "=", "BUILDING")),
    (Item("orders.o_orderkey"), Item("customer.c_custkey"), Item("orders.o_totalprice")),
)
_BIG = Spec(Table("orders"), where=(Compare("o_totalprice", ">", 400000), Compare("o_orderstatus", "=", "F")), items=(Item("o_custkey"),))
_NOT_IN = Spec(Table("customer"), where=(Sub("not in", _BIG, "c_custkey"),), items=(Item("c_custkey"), Item("c_name")))
_IN = Spec(Table("customer"), where=(Sub("in", _BIG, "c_custkey"),), items=(Item("c_custkey"), Item("c_name")))
_SCALAR = Spec(Table("customer"), where=(Sub("scalar", Spec(Table("orders"), items=(Item("count(*) / 200", None, "aggregate"),)), "c_custkey", "<"),), items=(Item("c_custkey"),))
_OUTER = Spec(Table("customer"), (Join("left", Table("orders"), (Same("customer.c_custkey", "orders.o_custkey"),)),), (Compare("customer.c_acctbal", ">", 9000),), (Item("customer.c_custkey"), Item("orders.o_orderkey")))
_OPTIONAL = _with(_OUTER, where=(Compare("customer.c_acctbal", ">", 5000), Compare("orders.o_totalprice", ">", 350000)))
_TOP = _with(ORDERS, order=(("o_totalprice", True), ("o_orderkey", False)), limit=25)
_GROUP = Spec(Table("orders"), items=(Item("o_orderstatus"), COUNT, Item("max(o_totalprice)", "top", "aggregate")), group=("o_orderstatus",))
_WINDOW = Spec(Table("orders"), where=(Compare("o_totalprice", ">", 350000),), items=(Item("o_orderkey"), Item("CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS int8)", "r", "window")))
_SETOP = Spec(Table("orders"), where=(Compare("o_totalprice", ">", 440000),), items=(Item("o_custkey", "k"),), union=("UNION", Spec(Table("customer"), where=(Compare("c_acctbal", ">", 9900),), items=(Item("c_custkey"),))))
_TOPGROUP = Spec(Table("orders"), items=(Item("o_custkey"), COUNT), group=("o_custkey",), order=(("n", True), ("o_custkey", False)), limit=10)
_FLAGSHIP = Spec(
    Table("customer"),
    (Join("inner", Table("orders"), (Same("orders.o_custkey", "customer.c_custkey"),)), Join("inner", Table("nation"), (Same("customer.c_nationkey", "nation.n_nationkey"),))),
    (Compare("orders.o_totalprice", ">", 100000),),
    (Item("nation.n_name"), COUNT, Item("round(sum(orders.o_totalprice), 2)", "total", "aggregate")),
    group=("nation.n_name",), having="count(*) > 1", order=(("n", True), ("n_name", False)), limit=10,
)


def _expect(kept: Engine, hits: int = 0, subsumed: int = 0) -> None:
    if kept.metrics.hits != hits or kept.metrics.subsumed != subsumed:
        raise AssertionError(f"{kept.metrics.hits} hits and {kept.metrics.subsumed} subsumed, not {hits} and {subsumed}")


def _twice(spec: Spec, spark: SparkSession, base: str) -> DataFrame:
    kept = engine(spark, base)
    kept.query(spec)
    out = kept.query(spec)
    _expect(kept, hits=1)
    return out


def _subsumed(held: list[Spec], spec: Spec, spark: SparkSession, base: str) -> DataFrame:
    kept = engine(spark, base)
    for s in held:
        kept.query(s)
    out = kept.query(spec)
    _expect(kept, subsumed=1)
    return out


def _bumped(first: Spec, second: Spec, hits: int, spark: SparkSession, base: str) -> DataFrame:
    kept = engine(spark, base)
    kept.query(first)
    out = kept.query(second)
    _expect(kept, hits=hits)
    return out


def _after(spec: Spec, batch: Callable[[DataFrame], DataFrame], spark: SparkSession, base: str) -> DataFrame:
    kept = engine(spark, base)
    kept.query(spec)
    apply_changes(kept, "orders", batch(changes(spark, base)))
    return kept.query(spec)


def _text_twice(text: str, spark: SparkSession, base: str) -> DataFrame:
    kept = engine(spark, base)
    kept.sql(text)
    out = kept.sql(text)
    _expect(kept, hits=1)
    return out


def _text_after(text: str, batch: Callable[[DataFrame], DataFrame], spark: SparkSession, base: str) -> DataFrame:
    kept = engine(spark, base)
    kept.sql(text)
    apply_changes(kept, "orders", batch(changes(spark, base)))
    out = kept.sql(text)
    if kept.metrics.bypassed:
        raise AssertionError("answered without the cache")
    return out


def cdc_keyless(spark: SparkSession, base: str) -> DataFrame:
    """A table without a key after inserts and deletes of whole rows."""
    kept = engine(spark, base)
    kept.query(_KEYLESS)
    lines = table(spark, base, "lineitem")
    gone = lines.where("l_orderkey % 7 = 0").select(F.lit("D").alias("op"), F.lit(1).cast("bigint").alias("lsn"), *lines.columns)
    twice = lines.where("l_orderkey % 7 = 1").select(F.lit("I").alias("op"), F.lit(2).cast("bigint").alias("lsn"), *lines.columns)
    apply_changes(kept, "lineitem", gone.unionByName(twice))
    return kept.query(_KEYLESS)


def cdc_unchanged(spark: SparkSession, base: str) -> DataFrame:
    """Updates that leave out columns that didn't change."""
    kept = engine(spark, base)
    kept.query(_RANGE)
    orders = table(spark, base, "orders")
    sent = ["o_orderkey", "o_totalprice"]
    rows = orders.where("o_orderkey % 5 = 0").select(F.lit("U").alias("op"), F.lit(1).cast("bigint").alias("lsn"), *[F.col(c) if c == "o_orderkey" else (F.col(c) + 50000).alias(c) if c in sent else F.lit(None).cast(t).alias(c) for c, t in orders.dtypes])
    apply_changes(kept, "orders", rows.withColumn("unchanged", F.array(*[F.lit(c) for c in orders.columns if c not in sent])))
    return kept.query(_RANGE)


def cdc_schema_change(spark: SparkSession, base: str) -> DataFrame:
    """A base table with another schema: what was cached from it goes, and answers come from the new rows."""
    kept = engine(spark, base)
    kept.query(_RANGE)
    kept.alter_table("orders", table(spark, base, "orders").withColumn("o_totalprice", F.col("o_totalprice") / 2).withColumn("o_extra", F.lit(1)))
    return kept.query(_RANGE)


def cdc_transactions(spark: SparkSession, base: str) -> DataFrame:
    """Of two transactions in a changelog only the one whose end has come is applied."""
    kept = engine(spark, base)
    kept.query(_RANGE)
    orders = table(spark, base, "orders")
    log = orders.where("o_orderkey % 3 = 0").select(F.lit("D").alias("op"), "o_orderkey", F.lit("orders").alias("table"), F.to_json(F.struct(*orders.columns)).alias("row"), (F.col("o_orderkey") % 2).alias("txn"))
    ends = spark.createDataFrame([("C", 0)], "op string, txn bigint").select("op", F.lit(0).cast("bigint").alias("o_orderkey"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("row"), "txn")
    log = log.unionByName(ends).withColumn("lsn", F.lit(9).cast("bigint")).withColumn("key", F.lit(None).cast("string")).drop("o_orderkey")
    source = shared_root(spark, "log")
    log.write.parquet(source)
    follow(kept, spark.readStream.schema(log.schema).parquet(source), shared_root(spark, "stream")).awaitTermination()
    return kept.query(_RANGE)


def _only(op: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.where(F.col("op") == op)


def _truncate(df: DataFrame) -> DataFrame:
    last = df.where("op = 'I'").limit(1).withColumn("op", F.lit("T")).withColumn("lsn", F.lit(0).cast("bigint"))
    return last.unionByName(df.where("op = 'I'"))


def _all(df: DataFrame) -> DataFrame:
    return df


def cdc_stream_events(spark: SparkSession, base: str) -> DataFrame:
    """Last event per user, over a stream of the events table."""
    events = table(spark, base, "events")
    return latest_per_key(spark, f"{base}/events.parque*", events.schema, "user_id", ["ts", "event_id"], shared_root(spark, "stream")).select("user_id", "event_id", "event_type")


_EQ = _with(ORDERS, where=(Compare("o_orderstatus", "=", "F"), Compare("o_orderpriority", "=", "1-URGENT")))
_WIDE = _with(ORDERS, where=(Compare("o_orderstatus", "=", "F"),))
_SET = _with(ORDERS, where=(In("o_orderstatus", ("F", "O")),))
_POINT = _with(ORDERS, where=(Compare("o_orderstatus", "=", "O"), Between("o_totalprice", 100000, 200000)))
_HELD_C = Spec(Table("customer"), where=(Compare("c_mktsegment", "=", "BUILDING"),))
_HELD_O = Spec(Table("orders"), where=(Compare("o_totalprice", ">=", 300000),))

_KEYLESS = Spec(Table("lineitem"), where=(Compare("l_quantity", ">", 30),), items=(Item("l_returnflag"), COUNT, Item("round(sum(l_quantity), 2)", "qty", "aggregate")), group=("l_returnflag",))
_KEYLESS_JOIN = Spec(
    Table("lineitem"), (Join("inner", Table("orders"), (Same("lineitem.l_orderkey", "orders.o_orderkey"),)),), (Compare("orders.o_totalprice", ">", 300000),),
    (Item("orders.o_orderstatus"), COUNT), group=("orders.o_orderstatus",),
)
_KEYLESS_TOP = Spec(Table("lineitem"), items=tuple(Item(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), order=tuple((c, False) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), limit=5)
TEXTS = {
    "cte": "WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big GROUP BY o_custkey",
    "cte_chain": "WITH a(k, total) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'), b AS MATERIALIZED (SELECT k, max(total) AS top FROM a GROUP BY k) SELECT k, top FROM b WHERE top > 400000",
    "cte_join": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey) SELECT c.c_custkey, c.c_name, big.n FROM customer AS c JOIN big ON c.c_custkey = big.o_custkey WHERE c.c_acctbal > 1000",
    "derived": "SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE t.n > 12",
    "scalar_select": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE c_acctbal > 5000",
    "setop_chain_join": "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000 UNION SELECT o.o_custkey FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 440000",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cache_hit_same": partial(_twice, _FLAGSHIP),
    "cache_agg_over_rows": partial(_twice, _GROUP),
    "cache_in": partial(_twice, _IN),
    "cache_scalar": partial(_twice, _SCALAR),
    "cache_outer": partial(_twice, _OPTIONAL),
    "cache_subsumed_eq": partial(_subsumed, [_WIDE], _EQ),
    "cache_subsumed_range": partial(_subsumed, [_with(ORDERS, where=(Compare("o_totalprice", ">", 100000),))], _RANGE),
    "cache_subsumed_inset": partial(_subsumed, [_SET], _POINT),
    "cache_subsumed_join": partial(_subsumed, [_HELD_O, _HELD_C], _JOIN),
    "cache_limit_window": partial(_bumped, _TOP, _with(_TOP, limit=10, offset=5), 1),
    "cache_limit_bump": partial(_bumped, _TOP, _with(_TOP, limit=60), 0),
    "mv_groupby": partial(_twice, _GROUP),
    "mv_window": partial(_twice, _WINDOW),
    "mv_setop": partial(_twice, _SETOP),
    "mv_topn": partial(_twice, _TOPGROUP),
    "cdc_insert": partial(_after, _RANGE, _only("I")),
    "cdc_update_move": partial(_after, _RANGE, _all),
    "cdc_pk_change": partial(_after, _RANGE, lambda df: df.where("old_o_orderkey IS NOT NULL")),
    "cdc_delete": partial(_after, _RANGE, _only("D")),
    "cdc_truncate": partial(_after, _RANGE, _truncate),
    "cdc_join_invalidate": partial(_after, _JOIN, _all),
    "cdc_in": partial(_after, _IN, _all),
    "cdc_not_in_delete": partial(_after, _NOT_IN, _all),
    "cdc_scalar": partial(_after, _SCALAR, _all),
    "cdc_outer_terminal": partial(_after, _OUTER, _all),
    "cdc_outer_optional": partial(_after, _OPTIONAL, _all),
    "cdc_limit_delete": partial(_after, _TOP, _all),
    "cdc_mv_groupby": partial(_after, _GROUP, _all),
    "cdc_setop": partial(_after, _SETOP, _all),
    "cdc_stream_events": cdc_stream_events,
    "cache_keyless_count": partial(_twice, _KEYLESS),
    "cache_keyless_join": partial(_twice, _KEYLESS_JOIN),
    "cache_keyless_limit": partial(_twice, _KEYLESS_TOP),
    "cdc_keyless_join": partial(_after, _KEYLESS_JOIN, _all),
    **{f"cache_{name}": partial(_text_twice, text) for name, text in TEXTS.items()},
    **{f"cdc_{name}": partial(_text_after, text, _all) for name, text in TEXTS.items()},
    "cdc_setop_chain_insert": partial(_text_after, TEXTS["setop_chain_join"], _only("I")),
    "cdc_keyless": cdc_keyless,
    "cdc_unchanged": cdc_unchanged,
    "cdc_schema_change": cdc_schema_change,
    "cdc_transactions": cdc_transactions,
}

_PARTS = {
    "cdc_insert": f"orders AS (SELECT o_orderkey, o_custkey, o_totalprice, {_SAME} FROM main.orders UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice, {_SAME} FROM main.orders WHERE o_orderkey % 50 = 2)",
    "cdc_delete": "orders AS (SELECT * FROM main.orders WHERE o_orderkey % 50 <> 1)",
    "cdc_truncate": f"orders AS (SELECT o_orderkey + 1000000000 AS o_orderkey, o_custkey, o_totalprice, {_SAME} FROM main.orders WHERE o_orderkey % 50 = 2)",
    "cdc_pk_change": "orders AS (SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 3 THEN o_orderkey + 2000000000 ELSE o_orderkey END AS o_orderkey) FROM main.orders)",
}

ORACLE_SQL: dict[str, str] = {name: q.args[-1].sql() for name, q in QUERIES.items() if isinstance(q, partial) and q.func in (_twice, _subsumed)}
ORACLE_SQL |= {"cache_limit_window": _with(_TOP, limit=10, offset=5).sql(), "cache_limit_bump": _with(_TOP, limit=60).sql()}
ORACLE_SQL |= {name: f"WITH {_PARTS.get(name, AFTER)} {q.args[0].sql()}" for name, q in QUERIES.items() if isinstance(q, partial) and q.func is _after}
ORACLE_SQL |= {name: ORACLE_SQL[name].replace("count(*) / 200", "count(*) // 200") for name in ("cache_scalar", "cdc_scalar")}
ORACLE_SQL["cdc_stream_events"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _with_tables(tables: str, text: str) -> str:
    return f"WITH {tables}, {text[5:]}" if text.startswith("WITH ") else f"WITH {tables} {text}"


ORACLE_SQL |= {f"cache_{name}": text for name, text in TEXTS.items()}
ORACLE_SQL |= {f"cdc_{name}": _with_tables(AFTER, text) for name, text in TEXTS.items()}
ORACLE_SQL |= {
    "cdc_setop_chain_insert": _with_tables(_PARTS["cdc_insert"], TEXTS["setop_chain_join"]),
    "cdc_keyless": f"WITH lineitem AS (SELECT * FROM main.lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT * FROM main.lineitem WHERE l_orderkey % 7 = 1) {_KEYLESS.sql()}",
    "cdc_unchanged": f"WITH orders AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 50000 ELSE o_totalprice END AS o_totalprice) FROM main.orders) {_RANGE.sql()}",
    "cdc_schema_change": f"WITH orders AS (SELECT * REPLACE (o_totalprice / 2 AS o_totalprice) FROM main.orders) {_RANGE.sql()}",
    "cdc_transactions": f"WITH orders AS (SELECT * FROM main.orders WHERE o_orderkey % 6 <> 0) {_RANGE.sql()}",
}
