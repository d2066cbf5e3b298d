"""Links and trees on the step tables, binary files and their headers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halospark.operators import links as L
from halospark.operators import tree as T
from halospark.plans.fixtures import MIN_MEMBERS, STEPS, members
from halospark.sources import binary as B
from halospark.sources import text

SF = "/root/testdata/sf0.01"


def test_link_counts(spark):
    """Counts that a sequential run of the rules gives on these tables."""
    from halospark.scratch import cut

    links = cut(L.link_steps(members(spark, SF), list(range(STEPS)), MIN_MEMBERS))
    born = {r["step"]: r["n"] for r in links.filter("status = 1").groupBy("step").agg(F.count("*").alias("n")).collect()}
    assert born == {0: 582, 1: 30}
    after = links.select((F.col("step") - 1).alias("step"), "mbp")
    lost = {r["step"]: r["n"] for r in links.join(after, ["step", "mbp"], "left_anti").groupBy("step").agg(F.count("*").alias("n")).collect()}
    assert [lost[s] for s in range(4)] == [42, 44, 43, 43]
    many = links.filter("status = 4").groupBy("step").agg(F.count_distinct("nowhid").alias("n"))
    assert {r["step"]: r["n"] for r in many.collect()} == {1: 195, 2: 180, 3: 94, 4: 47}
    assert T.build_tree(links).select("gid").distinct().count() == 612


def test_lost_and_found_line_gets_a_new_gid_and_ties_go_to_the_smallest(spark):
    rows = [(0, 5, 1, 10, 10), (1, 5, 1, 10, 10), (3, 5, 1, 10, 10), (0, 7, 1, 10, 10)]
    df = spark.createDataFrame(rows, "step int, mbp long, nowhid long, mass long, fofhmass long")
    got = {(r["step"], r["mbp"]): (r["gid"], r["majorgid"]) for r in T.build_tree(df).collect()}
    assert got == {(0, 5): (0, 0), (1, 5): (0, 0), (0, 7): (1, 0), (3, 5): (2, 2)}
    mass = spark.createDataFrame([(1, 9, 4), (1, 3, 4), (2, 8, 1)], "hid long, mbp long, prevmass long")
    assert {r["mbp"]: r["rank"] for r in L.major_progenitor(mass).collect()} == {3: 1, 9: 2, 8: 1}


def test_binary_round_trip(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("indx"), *(F.col("id").cast("float").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    path = str(tmp_path / "snap")
    B.write_records(df.repartition(3), path, B.SNAPSHOT, "ascii", {"Nx": 8})
    back = B.read_records(spark, path, B.SNAPSHOT, "ascii", 64)
    assert back.rdd.getNumPartitions() > 3
    assert sorted((r["indx"], r["x"]) for r in back.select("indx", "x").collect()) == [(i, float(i)) for i in range(1000)]
    cat = str(tmp_path / "halos")
    B.write_records(spark.range(5).select((F.col("id") + 20).alias("np"), *(F.lit(1.5).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz"))).coalesce(1), cat, B.HALO, B.HALO_HEADER, {"size": 512, "nx": 64})
    assert B.read_records(spark, cat, B.HALO, B.HALO_HEADER).agg(F.sum("np")).first()[0] == 110
    head = B.read_header(spark, cat, B.HALO_HEADER).first()
    assert head["size"] == 512 and head["nx"] == 64
    with open(tmp_path / "bad.bin", "wb") as f:
        f.write(b"123")
    with pytest.raises(Exception):
        B.read_records(spark, str(tmp_path / "bad.bin"), B.SNAPSHOT).count()


def test_array_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2, 3], [4, 5, 6], [0.5, 1.5, 2.5])], "gid long, mbp array<long>, nowhid array<long>, mass array<double>")
    B.write_records(df.coalesce(1), str(tmp_path / "t"), B.TREE.format(n=3))
    r = B.read_records(spark, str(tmp_path / "t"), B.TREE.format(n=3)).first()
    assert r["mbp"] == [1, 2, 3] and r["mass"] == [0.5, 1.5, 2.5]


def test_runs_and_params(spark, tmp_path):
    halos = spark.createDataFrame([(0, 3), (1, 0), (2, 2), (300, 1)], "hid long, np long")
    rows = spark.range(6).select(F.col("id").alias("row"))
    assert [r["hid"] for r in text.assign_runs(rows, halos, 100).orderBy("row").collect()] == [0, 0, 0, 2, 2, 300]
    (tmp_path / "p.dat").write_text("# a comment\ndefine Nx = 64\ndefine Odd = 3 4\n\n#End of Ascii Header\ndefine Late = 1\n")
    got = {r["key"]: (r["value"], r["known"]) for r in text.read_params(spark, str(tmp_path / "p.dat")).collect()}
    assert got == {"Nx": ("64", True), "Odd": ("3 4", False)}
    assert np.isclose(text.read_table_ascii(spark, str(tmp_path / "k.txt") if (tmp_path / "k.txt").write_text("# k\n 1.0  2e3\n") else "", ["k", "p"]).first()["p"], 2000)


def test_ranges_are_skipped_by_bounds_and_filters(spark, tmp_path):
    """Records in order of z: bounds, and pushed filters, leave out the ranges and files that cannot hold what is asked for."""
    df = spark.range(3000).select(*(F.col("id").cast("float").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")), F.col("id").alias("indx"))
    path = tmp_path.as_uri() + "/snap"
    B.write_records(df.repartitionByRange(6, "z"), path, B.SNAPSHOT, "ascii", {"Nx": 8})
    B.write_records(df.filter("z < 10").coalesce(1), path, B.SNAPSHOT, "ascii")
    assert sorted(p.suffix for p in (tmp_path / "snap").iterdir() if p.is_file() and not p.name.startswith(".")) == [".bin"] * 7 and not list((tmp_path / "snap").glob("_temporary*"))
    everything = B.read_records(spark, path, B.SNAPSHOT, "ascii")
    assert everything.count() == 3010
    part = B.read_records(spark, path, B.SNAPSHOT, "ascii", bounds=[("z", ">=", 1000), ("z", "<", 1100)])
    seen = {r["indx"] for r in part.select("indx").collect()}
    assert set(range(1000, 1100)) <= seen and len(seen) < 1100
    found = everything.filter("z >= 2990 and x < 2995")
    assert sorted(r["indx"] for r in found.collect()) == list(range(2990, 2995))
    options = {"path": path, "layout": B.SNAPSHOT, "header": "ascii"}
    reader = B._Reader(options)
    whole = sum(p.count for p in reader.partitions())
    list(reader.pushFilters([B.GreaterThanOrEqual(("z",), 2990.0), B.LessThan(("x",), 2995.0)]))
    assert whole == 3010 and sum(p.count for p in reader.partitions()) < 700
    assert sum(p.count for p in B._Reader(options | {"bounds": '[["indx", "=", 99999]]'}).partitions()) == 0


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    rows = spark.range(10).select(*(F.lit(1.0).cast("float").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")), F.when(F.col("id") < 9, F.col("id")).alias("indx"))
    with pytest.raises(Exception, match="no nulls"):
        B.write_records(rows.repartition(2), str(tmp_path / "snap"), B.SNAPSHOT)
    assert [p for p in (tmp_path / "snap").rglob("*") if p.is_file()] == []


def test_parameters_beside_a_snapshot(spark, tmp_path):
    from halospark.sources import tables

    rows = spark.createDataFrame([(s, i, float(i), 0.0, float(i)) for s in (1, 2) for i in range(20)], "step int, indx long, x double, y double, z double")
    params = spark.createDataFrame([(1, "Omega", "0.26"), (1, "Nx", "8"), (2, "Omega", "0.26")], "step int, key string, value string")
    path = str(tmp_path / "snap")
    tables.write_snapshot(rows, path, params=params)
    assert spark.read.parquet(path).count() == 40 and set(spark.read.parquet(path).columns) == set(rows.columns)
    assert {r["step"]: r["params"] for r in tables.read_step_params(spark, path).collect()} == {1: {"Omega": "0.26", "Nx": "8"}, 2: {"Omega": "0.26"}}
