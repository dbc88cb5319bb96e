"""Every query that has SQL against DuckDB, the whole result; and the entry without the optional parts."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from moundline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in ("__spark_entry__.py", "moundline", "tests"):
        subprocess.run(["cp", "-r", f"{root}/{f}", tmp_path], check=True)
    for f in ("moundline/llm", "tests/llm"):
        shutil.rmtree(tmp_path / f, ignore_errors=True)  # they may be gone already
    # Libraries may come by PYTHONPATH; only the repository itself must not.
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(root)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(path)}
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 30
    # What the relational queries give is tested above, so here the other tests, and that all of them can be collected.
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *args], cwd=tmp_path, env=env, capture_output=True, text=True)
    for args in (["tests", "--collect-only"], ["tests/test_clean.py", "tests/test_metrics.py", "tests/test_queries.py", "-k", "not without and (not sql or mix_by_count)"]):
        out = run(*args)
        assert out.returncode == 0, out.stdout[-3000:] + out.stderr[-2000:]


def test_filters_hold_no_lookups(spark):
    """Spark puts the expression of a column in place of each mention in a filter; with the lookup of folded codes that was most of the first stage (104 of 113 task seconds)."""
    for query in (catalogue.cleaned, catalogue.prepared):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        held = [line for line in plan.splitlines() if re.match(r"[ +:|-]*Filter", line)]
        assert held and not any("element_at" in line for line in held)
