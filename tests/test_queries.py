"""Queries against their SQL on the smallest tables, and the entry module with and without the text subpackage."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from halospark.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: One of each kind; the driver compares all.
SOME = ("p3_min_image", "p9_flags", "f3_shell_filter", "j1_fixed_radius_pairs", "g1_fof_groups", "a1_halo_catalog", "a6_pair_potential", "a15_deposit_tsc", "a20_power_spectrum", "a23_mass_function", "a29_mass_accretion_history", "a32_column_contour", "j3_assign_observer", "j14_trace_down", "j17_snapshot_schedule", "t2_build_tree", "t3_sort_by_major_gid", "s1_read_snapshot", "r1_stream_products", "r3_stream_link", "v1_missing_link_fraction", "h2_density_peaks", "h3_separate_contours", "c2_disk_lightcone", "c1_cone_run")


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in result.fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=str)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


def test_queries_without_the_text_subpackage(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("halospark.llm") else find(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) <= set(QUERIES)
