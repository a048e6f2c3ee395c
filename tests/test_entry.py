import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree_in_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_operators():
    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("siteloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "canonical_url" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in [*e.queries(), *e.oracle_sql()] if n[2:3].isdigit() or n == "pipeline")
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def same(rows):
    return sorted(repr(tuple(rows_)) for rows_ in rows)


@pytest.mark.parametrize("name", ["url_components", "canonical_url", "tracking_params", "offline_path", "page_links", "link_kinds", "frontier_new", "local_refs", "spa_signals", "archive_listing", "incremental_actions", "manifest_upsert", "manifest_rows", "rewritten_attrs", "rewritten_assets", "page_assets", "asset_fan_out", "captures_kept", "decoded_bodies", "closure_missing", "rendered_links", "rendered_resources", "start_problems", "sql_functions"])
def test_query_equals_its_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{DATA}/pages.parquet')")
    out = con.sql(__spark_entry__.oracle_sql()[name])
    at = [out.columns.index(c) for c in df.columns]
    assert same([r[i] for i in at] for r in out.fetchall()) == same(df.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
