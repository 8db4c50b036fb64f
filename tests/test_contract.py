import subprocess
import sys

from tests.conftest import DATA, ROOT


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_relational_query_has_sql():
    from tidemark.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_imports_without_the_text_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tidemark.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name=name.split('.queries')[0])\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())\n"
        "assert 'tidemark.llm' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_sources_are_parquet_tables(spark):
    from tidemark.sources import table

    plan = table(spark, DATA, "orders").where("o_totalprice > 1").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]
