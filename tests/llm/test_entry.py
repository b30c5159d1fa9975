"""The entry as a driver reads it: in a process of its own, before there is a session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LISTED = """
import __spark_entry__ as entry, corpus_pipeline
from pyspark import SparkContext
queries, sql = entry.queries(), entry.oracle_sql()
assert all(callable(f) for f in queries.values()) and set(sql) <= set(queries) and corpus_pipeline.STAGES
assert SparkContext._active_spark_context is None
print(*queries)
"""


def test_queries_are_listed_without_a_session():
    said = subprocess.run([sys.executable, "-B", "-c", LISTED], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "pipeline" in names and "exact2_rules" in names
    assert all(sum(name.startswith(f"op{n}_") for name in names) == 1 for n in range(1, 11))
