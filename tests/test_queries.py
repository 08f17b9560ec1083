"""Queries against their SQL answers over whole tables; the driver runs all of them."""
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["extract_cells", "classify_structure", "header_paths", "sidebar_paths", "total_links",
         "audit_totals", "type_fractions", "detail_type", "write_export", "label_join",
         "stratified_folds"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], (int, float))
                        and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(answer.fetchall(), columns)


def test_every_answer_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    got = {(r.kind, r.verdict): r["count"] for r in entry.entry(spark).collect()}
    assert got["order", "genuine"] == 1500 and got["event", "error"] > 0


def test_listing_queries_needs_no_session():
    """The driver lists queries before it has a session."""
    import subprocess
    import sys
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                          cwd=os.path.dirname(os.path.abspath(entry.__file__)))
    assert done.returncode == 0, done.stderr[-500:]
    queries, answers = map(int, done.stdout.split()[-2:])
    assert queries >= answers > 100
