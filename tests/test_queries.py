import duckdb
import pytest

import __spark_entry__
from tessera.plans.catalogue import ORACLES, QUERIES
from tessera.session import TABLES


def told(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(told, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(told(list(r)) for r in df.collect()) == sorted(told([r[k] for k in order]) for r in want.fetchall())


def test_queries_without_sql(spark, sf):
    """Their operators are held against brute force in the other tests of this folder."""
    rows = {n: QUERIES[n](spark, sf).count() for n in sorted(set(QUERIES) - set(ORACLES))}
    assert rows == {
        "approx_distinct_users": 5, "enrich_queries": 120, "extract_components": 1600, "extract_interfaces": 400, "extract_quantities": 600, "extract_terms": 200, "extract_variables": 1200,
        "hashed_search": 200, "knn_int8": 125, "near_duplicates_kept": 87, "nested_split_args": 800, "remove_annotations": 200, "replace_contained": 3,
    }


def test_int8_recall(spark, sf):
    """Of the exact five nearest, how many the codes find."""
    got = {(r.query_id, r.vec_id) for r in QUERIES["knn_int8"](spark, sf).collect()}
    want = {(r.query_id, r.vec_id) for r in QUERIES["knn_topk"](spark, sf).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_catalogue_as_a_table(spark):
    from tessera.operators.hooks import exported

    rows = {r.name: r for r in exported(spark, QUERIES, ORACLES).collect()}
    assert set(rows) == set(QUERIES) and {n for n, r in rows.items() if r.has_sql} == set(ORACLES)


def test_entry(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert 0 < __spark_entry__.entry(spark).count() <= 100
