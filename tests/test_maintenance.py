"""Every catalogue query that can be cached: served after a change batch equals run anew on the changed tables."""

from collections import Counter

import pytest

from tests.conftest import DATA
from tidemark.plans import cached, catalogue
from tidemark.plans.dialect import Unsupported
from tidemark.reason import analysis
from tidemark.reason.parse import parse
from tidemark.reason.spec import Between, Compare, In, Opaque, Same, Sub
from tidemark.streaming.changes import apply_changes


def cacheable():
    for name, sql in sorted(catalogue.SQL.items()):
        try:
            spec = parse(sql)
        except Unsupported:
            continue
        if analysis.uncacheable(spec) is None:
            yield name


def bag(df):
    return Counter(map(repr, df.collect()))


@pytest.mark.parametrize("name", list(cacheable()))
def test_served_equals_recomputed(spark, name):
    sql = catalogue.SQL[name]
    kept = cached.engine(spark, DATA)
    expected = bag(catalogue.run_sql(spark, DATA, sql))
    assert bag(kept.sql(sql)) == expected
    assert bag(kept.sql(sql)) == expected
    assert kept.metrics.hits == 1
    if "orders" in parse(sql).relations():
        apply_changes(kept, "orders", cached.changes(spark, DATA))
        assert bag(kept.sql(sql)) == bag(kept._run(parse(sql), kept.base))


def test_parameters_share_an_entry(spark):
    kept = cached.engine(spark, DATA)
    kept.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2", [200000, "F"])
    kept.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
    assert kept.metrics.hits == 1
    kept.sql("SELECT o_orderkey FROM orders WHERE 300000 < o_totalprice AND o_orderstatus = 'F'")
    assert kept.metrics.subsumed == 1
    kept.sql("WITH a AS (SELECT 1 AS x) SELECT x FROM a WHERE x = $1", [1])
    assert kept.metrics.bypassed == 1


def test_conditions():
    spec = parse("SELECT * FROM t WHERE 5 < a AND b BETWEEN 1 AND 3 AND c = ANY (ARRAY[1, 2]) AND d NOT IN ('x', 'it''s') AND (e = 1 OR f = 2) AND t.g = t.h AND k NOT IN (SELECT k FROM u)")
    assert [type(c) for c in spec.where] == [Compare, Between, In, In, Opaque, Same, Sub]
    assert spec.where[0] == Compare("a", ">", 5) and spec.where[3].values == ("x", "it's")
    assert parse(spec.sql()) == spec
