"""Some of the registered queries against their SQL; the driver runs all of them."""

import duckdb
import pytest

from motifloom import queries

NAMES = ["snap_scan_checked", "snap_scan_refused", "saved_vertices", "metadata", "query_file", "changes_file", "update_split", "work_by_triangles", "speedups", "memory_report", "run_log", "running_count", "plan_lines", "pattern_facts", "p3_planned_by_density", "delta_triangle_vertex", "delta_labelled_triangle", "graph_stats", "p3_vertex", "p5_iep", "labelled_p3_array", "motif3_census", "delta_diamond", "set_algebra", "degree_classes", "pair_set_stats", "degree_relabel"]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data, duck, name):
    got = queries.queries()[name](spark, data).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    got = {r["pattern"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert got == {"triangle": 226, "p1": 43, "p3": 44, "house": 522}
