"""Pairs, groups and numbering against brute force on small boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halospark.operators import fof
from halospark.operators import pairs
from halospark.operators.pairs import fixed_radius_pairs, knn_in_group
from halospark.plans import fixtures

BOX, B = 1024, 20


def points(seed, n, box=BOX):
    rng = np.random.default_rng(seed)
    clumps = rng.integers(0, box, (max(1, n // 12), 3))
    xyz = (clumps[rng.integers(0, len(clumps), n)] + rng.integers(-25, 26, (n, 3))) % box
    return [(int(i), *map(int, p)) for i, p in enumerate(xyz)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "indx long, x long, y long, z long")


def brute_pairs(rows, b=B, box=BOX):
    out = set()
    for k, (i, *p) in enumerate(rows):
        for j, *q in rows[k + 1 :]:
            d = np.abs(np.subtract(p, q))
            d = np.minimum(d, box - d)
            if (r2 := int((d * d).sum())) <= b * b:
                out.add((min(i, j), max(i, j), r2))
    return out


def brute_labels(rows, b=B, box=BOX):
    up = {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j, _ in brute_pairs(rows, b, box):
        a, c = root(i), root(j)
        up[max(a, c)] = min(a, c)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("seed,n", [(1, 300), (2, 80)])
def test_pairs_and_groups(spark, seed, n):
    rows = points(seed, n)
    df = frame(spark, rows)
    assert {tuple(r) for r in fixed_radius_pairs(df, B, BOX).collect()} == brute_pairs(rows)
    want = brute_labels(rows)
    for blocks in (3, 8):
        assert {r["indx"]: r["label"] for r in fof.fof_groups(df, B, BOX, blocks).collect()} == want


def test_group_edges(spark):
    exact = [(0, 0, 0, 0), (1, B, 0, 0), (2, B + B + 1, 0, 0), (3, BOX - B, 0, 0), (4, 500, 0, BOX - 1), (5, 500, 0, B - 1)]
    got = {r["indx"]: r["label"] for r in fof.fof_groups(frame(spark, exact), B, BOX).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4} == brute_labels(exact)
    assert fof.fof_groups(frame(spark, []), B, BOX).count() == 0
    assert fof.fof_groups(frame(spark, [(7, 1, 2, 3)]), B, BOX).collect()[0]["label"] == 7


def test_prefilter_keeps_large_groups(spark):
    rows = points(3, 400)
    kept = {r["indx"] for r in fof.prefof_filter(frame(spark, rows), B, BOX, 128, least=10).collect()}
    labels = brute_labels(rows)
    sizes = {v: list(labels.values()).count(v) for v in labels.values()}
    assert {i for i, v in labels.items() if sizes[v] >= 10} <= kept


def test_unwrap_joins_what_faces_cut(spark):
    rows = [(1, i, x, 5, 5, 0, 0, 0) for i, x in enumerate((BOX - 4, BOX - 1, 2, 6))] + [(2, 10 + i, 500 + i, 5, 5, 0, 0, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "hid long, indx long, x long, y long, z long, vx long, vy long, vz long")
    got = {r["indx"]: r["x"] for r in fof.unwrap(df, B, BOX).collect()}
    assert [got[i] for i in range(4)] == [-4, -1, 2, 6] and got[10] == 500


def test_dense_numbers_and_knn(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("v"))
    for parts in (1, 3, 8):
        got = [r["n"] for r in fof.dense_numbers(df, [F.col("v")], "n", parts).orderBy("v").collect()]
        assert got == list(range(1000))
    rows = points(4, 60)
    members = frame(spark, rows).withColumn("hid", F.col("indx") % 3)
    for leaf in (256, 3):
        got = {(r["id"], r["rank"]): r["other"] for r in knn_in_group(members, 4, BOX, leaf=leaf).collect()}
        assert len(got) == 240
        for i, *p in rows:
            assert [got[i, k + 1] for k in range(4)] == [j for _, j in nearest_of(i, p, rows[i % 3 :: 3])[:4]]


def nearest_of(i, p, rows):
    d = np.abs(np.array([r[1:] for r in rows]) - p)
    d = np.minimum(d, BOX - d)
    return sorted((int(r2), r[0]) for r, r2 in zip(rows, (d * d).sum(axis=1)) if r[0] != i)


def test_neighbours_in_a_large_group_with_a_far_point(spark):
    """Dense clumps, points at one place, a lone point far off and a group of two: each leaf meets a bounded number of others."""
    rng = np.random.default_rng(11)
    rows = [(int(i), *map(int, p)) for i, p in enumerate(np.concatenate([rng.normal(200, 12, (3000, 3)), rng.normal(240, 3, (2000, 3)), [[30, 30, 30]] * 150, [[700, 900, 650]]]).round().astype(int) % BOX)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 9001, 5, 5, 5), (2, 9002, 5, 5, 9)], "hid long, indx long, x long, y long, z long").repartition(4)
    got = {}
    for r in knn_in_group(df, 5, BOX, leaf=40).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["r2"], r["other"])
    assert len(got) == len(rows) + 2 and got[9001] == {1: (16, 9002)}
    for i in [*range(0, 5000, 97), *range(5000, 5151, 30), 5150]:
        assert [got[i][k + 1] for k in range(5)] == nearest_of(i, rows[i][1:], rows)[:5]


def test_labels_of_a_dense_cell_are_found_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(fof, "TOGETHER", 1000)
    rng = np.random.default_rng(8)
    pos = np.concatenate([rng.random((400, 3)), rng.random((100, 3)) * 40, [[100.0, 0, 0], [101.0, 0, 0], [103.0, 0, 0]]])
    ids = rng.permutation(len(pos)).astype(np.int64) * 3
    label = fof.local_labels(ids, pos, 1.5)
    up = list(range(len(pos)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(pos)):
        for j in range(i):
            if ((pos[i] - pos[j]) ** 2).sum() <= 1.5**2:
                up[max(root(i), root(j), key=lambda k: ids[k])] = min(root(i), root(j), key=lambda k: ids[k])
    assert [ids[root(i)] for i in range(len(pos))] == label.tolist()


def test_dense_blocks_are_halved(spark):
    """Clumps at faces, edges and corners of the box in a few blocks: parts of different sizes side by side give the same groups."""
    rng = np.random.default_rng(14)
    rows = [(int(i), *map(int, p)) for i, p in enumerate(np.concatenate([points(5, 250), [(0, *(rng.normal(c, 40, 3)).round().astype(int) % BOX) for c in ((0, 0, 0), (512, 512, 500), (250, 30, 900)) for _ in range(150)]])[:, 1:])]
    df, want = frame(spark, rows), brute_labels(rows)
    halved = fof._halvings(df.withColumnRenamed("indx", "id"), B, 256, 20)
    assert {r["_k"] for r in halved.collect()} >= {1, 2}
    got = [{r["indx"]: r["label"] for r in fof.fof_groups(df, B, BOX, 4, most=m).collect()} for m in (20, 10**6)]
    assert got[0] == got[1] == want


@pytest.mark.parametrize("radius,box,most", [(20, 1024, 10**6), (20, 1024, 15), (300, 960, 10**6), (7, 21, 10**6)])
def test_pairs_by_blocks(spark, monkeypatch, radius, box, most):
    """r04 F4: a place is copied to the blocks it is near, not to the cells around it, with the same pairs from whole and halved blocks and at any radius."""
    rows = points(32, 150, box) + [(1000 + k, box - 1, (k * 7) % box, 0) for k in range(8)] + [(2000 + k, 0, 0, 0) for k in range(5)]
    monkeypatch.setattr(pairs, "MOST_LISTS", most)
    found = fixed_radius_pairs(frame(spark, rows).repartition(3), radius, box)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, radius, box) and len(got) > 10 and ("Join" in plan) == (most < 100)


def test_near_places_are_compared_in_bounded_parts(monkeypatch):
    """r04 F4."""
    rng = np.random.default_rng(45)
    place = [rng.integers(-50, 50, 300) for _ in "xyz"]
    monkeypatch.setattr(pairs, "COMPARED", 200)
    parts = list(pairs._near(place, 15))
    got = [(min(a, b), max(a, b), r2) for i, j, r in parts for a, b, r2 in zip(i.tolist(), j.tolist(), r.tolist())]
    want = {(i, j, r2) for i in range(300) for j in range(i, 300) if (r2 := int(sum((p[i] - p[j]) ** 2 for p in place))) <= 225}
    assert len(parts) > 14 and len(got) == len(set(got)) and set(got) == want  # 14 ways to a neighbouring cell


def test_rows_of_halved_blocks_are_dealt_without_a_shuffle(spark, monkeypatch):
    """r04 F7, F8: a row goes once to each part it is near, one of which is its own, and nothing is aggregated or written for it."""
    rows = frame(spark, points(15, 400)).withColumnRenamed("indx", "id")
    halved = fof._halvings(rows, B, 256, 20)
    monkeypatch.setattr(fof, "cut", lambda d: pytest.fail("written"))
    dealt = fof._parts(rows, B, BOX, 256, halved)
    assert "Aggregate" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    got = dealt.select("id", "_block", "_own", "_shared").collect()
    copies = {}
    for r in got:
        copies.setdefault(r["id"], []).append(r)
    assert halved.count() and len({r[:2] for r in got}) == len(got) and len(copies) == 400
    assert all(sum(r["_own"] for r in c) == 1 and (len(c) == 1 or all(r["_shared"] for r in c)) for c in copies.values())
    cut_twice = spark.createDataFrame([(1, i, x, y, 5) for i, (x, y) in enumerate([(2, 3), (BOX - 3, 3), (2, BOX - 2), (BOX - 3, BOX - 2)])], "hid long, indx long, x long, y long, z long")
    assert sorted((r["x"], r["y"]) for r in fof.unwrap(cut_twice, B, BOX).collect()) == [(-3, -2), (-3, 3), (2, -2), (2, 3)]


def test_labels_of_a_clump_do_not_cost_its_pairs(monkeypatch):
    """r04 F7, F8: 10,000 points a clump, where a few points of neighbouring cells are tried before all."""
    rng = np.random.default_rng(44)
    pos, looked = rng.integers(0, 128, (10_000, 3)).astype(float), []
    monkeypatch.setattr(fof.np, "repeat", lambda a, n, plain=np.repeat: looked.append(np.sum(n)) or plain(a, n))
    assert set(fof.local_labels(np.arange(10_000), pos, 40.0).tolist()) == {0} and sum(looked) < 100_000


def test_rows_at_one_place_are_compared_once(spark):
    """places are joined and not rows, in lists of bounded length, with the same pairs as brute force."""
    rng = np.random.default_rng(31)
    places = [tuple(map(int, p)) for p in rng.integers(0, 60, (12, 3))]
    rows = [(k, *places[k % 12 if k < 60 else 0]) for k in range(300)] + [(300, BOX - 1, 1, 1), (301, 0, 0, 0)]
    df = spark.createDataFrame(rows, "indx long, x long, y long, z long").repartition(3)
    own = df.withColumnRenamed("indx", "id")
    assert pairs._places(own, 1024).count() == len({r[1:] for r in rows})
    assert pairs._places(own, 50).count() > len({r[1:] for r in rows}) and max(len(r["ids"]) for r in pairs._places(own, 50).collect()) < 120
    for together in (1024, 50):
        found = [tuple(r) for r in fixed_radius_pairs(df, B, BOX, together=together).collect()]
        assert len(found) == len(set(found)) and set(found) == brute_pairs(rows)


def test_places_of_large_keys(spark, tmp_path):
    """r04 F1 to F8: the factors' products pass 2^63 at 6 GB, where Spark ends with an overflow."""
    keys = [(0, 0, 1), (53_999_999, 7_199_999, 7), (53_999_998, 7_199_998, 3), (10**15, 5, 2)]
    spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for order, pk, line in keys:
        indx = order * 64 + line
        axes = ((40503, 7919, 2654435761), (69069, 104729, 2246822519), (48271, 1299709, 3266489917))
        want[indx] = tuple(indx * f % 131072 // 8 if indx % 10 == 0 else (pk * near + indx * spread % 8192 // 64 - 64 + 16384) % 16384 for f, near, spread in axes)
    for made in (fixtures.particles, fixtures.clumps):
        assert {r["indx"]: (r["x"], r["y"], r["z"]) for r in made(spark, str(tmp_path)).collect()} == want
