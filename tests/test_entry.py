import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from attestra.plans import registry
from tests.oracle import compare

REPO = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout) >= 60


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    got, expected = compare(spark, SMALL, name, registry.QUERIES[name], registry.SQL[name])
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_library_does_not_import_the_training_part():
    for path in (REPO / "attestra").rglob("*.py"):
        if "llm" not in path.relative_to(REPO / "attestra").parts:
            assert "attestra.llm" not in path.read_text()
