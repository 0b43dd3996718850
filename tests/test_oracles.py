"""Queries against their DuckDB texts; all of them with TEST_ALL=1, else one of each family."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from trustlake.plans.queries import ORACLE_SQL, QUERIES

FEW = "normalize_unified posture_from_compliance token_scope_width parse_tags graph_edge_events edges_agg graph_incremental blast_radius_3 bytes_spike_score new_resource_count_win siem_score static_decision raac_fuse ecdf_calibrate time_split feature_matrix".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if not isinstance(v, (int, str)):
        v = float(v)
        return None if math.isnan(v) else int(v) if v == int(v) else v
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL) if os.environ.get("TEST_ALL") else FEW)
def test_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    said = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(got, key=key) == sorted(want, key=key)
