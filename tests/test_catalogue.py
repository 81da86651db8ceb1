"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from kithwork.plans import catalogue, oracle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v) if not isinstance(v, datetime.datetime) else str(v.date())


def test_all_have_sql():
    assert set(catalogue.queries()) == set(oracle.oracle_sql())


QUICK = ["scan_knows", "knows_weight", "dense_relabel", "persons_by_birthday", "persons_in_place", "kth_largest", "pairs_within_h", "distance_histogram", "connected_components", "closeness_upper_bound", "tag_max_component", "place_closure", "batch_mixed", "q2_topk_tags_zero_fill", "q3_topk_pairs", "q4_topk_closeness", "scan_reply", "tag_component_steps", "approx_distance_sum", "estimate_error", "pairs_within_h_sparse", "closeness_upper_bound_3", "batch_from_files"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(oracle.oracle_sql()[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_flagship(spark):
    assert catalogue.flagship(spark, DATA).count() > 0
