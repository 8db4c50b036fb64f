import pytest

from tests.conftest import DATA
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
