"""A sample of registered queries against their SQL (tools/check.py runs all of them)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_trace_sessions", "s3_ragged_frames", "s13_captures", "c5_bits_to_payload", "p3_impute_ffill_per_trace",
    "p19_reject_counts", "t4_pack_sessions", "t10_collect_children", "w1_sessionize_count", "w18_propagate_sessions",
    "e1_min_max", "e18_normalise_per_session", "k6_table_tokens", "r10_conditional_draws", "r5_stratified_split",
    "m3_js_continuous", "m6_rank_js", "m11_associations", "m15_best_per_chunk", "u8_result_table",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    import pandas as pd

    got = entry.queries()[name](spark, SF).toPandas()
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = pd.DataFrame(cur.fetchall(), columns=cols)
    assert sorted(got.columns) == sorted(cols)
    assert canonical(got) == canonical(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
