"""Every registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SF

sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry_points  # noqa: E402

TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_a_twin():
    assert set(entry_points.QUERIES) == set(entry_points.ORACLE)
    assert set(entry_points.QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.QUERIES))
def test_query(spark, duck, name):
    table = entry_points.queries()[name](spark, SF)
    columns = sorted(table.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in table.collect())
    cursor = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    places = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in places)) for row in cursor.fetchall())
    assert kinds == {f.name: f.dataType.simpleString() for f in table.schema}
    assert got == expected
    assert got


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["zstandard", "webfrontier.llm", "corpus_pipeline"])
def test_core_queries_without_the_corpus_operators(missing):
    """The entry imports, and keeps the core queries, when a package or the corpus operators are absent."""
    script = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.QUERIES))"
    out = subprocess.run([sys.executable, "-c", script], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    found, core = map(int, out.split())
    assert core == len(entry_points.QUERIES) and found >= core
