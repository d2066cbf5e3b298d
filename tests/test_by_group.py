"""What is dealt by group once: plans without further shuffles, and the same results as by the ways for large groups."""

import re
import time

import numpy as np
import pytest

from halospark.operators import cone, ellipsoids, fof, grouped, halo, subhalo
from halospark.operators.pairs import knn_in_group


def spread_members(spark):
    """Halos of 1, 2, 40 and 90 members, of which some share a place."""
    rng = np.random.default_rng(21)
    rows = [(hid, hid * 1000 + k, *map(int, rng.integers(0, 400, 3))) for hid, n in ((1, 1), (2, 2), (3, 40), (4, 90)) for k in range(n)]
    rows += [(4, 4900 + k, *rows[-1 - k][2:]) for k in range(5)]
    return spark.createDataFrame(rows, "hid long, indx long, x long, y long, z long").repartition(3)


@pytest.mark.parametrize("made", ["halo_density", "spline_density", "peaks", "seeded"])
def test_halos_whole_in_tasks_are_as_those_over_many(spark, made):
    """the same with halos dealt whole, and split."""
    df = spread_members(spark)

    def run(whole):
        if made == "spline_density":
            return subhalo.spline_density(df, 50, 5, 4096, whole=whole)
        cells, back = subhalo.halo_density(df, 50, whole=whole)
        if made == "halo_density":
            return cells, back.select("hid", "indx", "density")
        peaks = subhalo.density_peaks(cells, 0.2)
        return (peaks if made == "peaks" else subhalo.seeded_peaks(peaks, df, 50, 3),)

    for a, b in zip(run(1000), run(30)):
        one, two = ({tuple(r)[:-1]: r["density"] for r in d.collect()} for d in (a, b))
        assert one.keys() == two.keys() and len(one) > 5 and all(np.isclose(one[k], two[k]) for k in one)


def exchanges(df) -> list[str]:
    """What a plan's shuffles are dealt by, but for those of the fixtures."""
    return re.findall(r"Exchange hashpartitioning\((.*), \d+\), [RE]", df._jdf.queryExecution().executedPlan().toString())


def by(df, key: str) -> bool:
    return len(found := exchanges(df)) == 1 and re.fullmatch(rf"{key}#\d+L", found[0]) is not None


def test_cells_of_halos_are_not_shuffled(spark, monkeypatch):
    """members are dealt by halo once, and their cells, which are many times as many, stay where they are."""
    df = spread_members(spark)
    monkeypatch.setattr(grouped, "SHARE", 20)
    cells, read = subhalo.spline_density(df, 50, 5, 4096)
    assert all(by(d, "hid") for d in (subhalo.halo_density(df, 50)[0], subhalo.density_peaks(subhalo.halo_density(df, 50)[0]), cells, read))


def test_splines_of_small_halos_are_made_in_their_task(spark, monkeypatch):
    """r04 F3, F5: no join of neighbours, nothing written, and the same cells and densities as by cells in Spark."""
    df = spread_members(spark)
    monkeypatch.setattr(subhalo, "cut", lambda d: pytest.fail("written"))
    made = subhalo.spline_density(df, 50, 5, 4096)
    assert not any("Join" in d._jdf.queryExecution().optimizedPlan().toString() for d in made)
    monkeypatch.undo()
    for a, b in zip(made, subhalo._large_splines(df, 50, 5, 4096, "hid", 1000)):
        one, two = ({tuple(r)[:-1]: r["density"] for r in d.collect()} for d in (a, b))
        assert one.keys() == two.keys() and len(one) > 40 and all(np.isclose(one[k], two[k], rtol=1e-12, atol=1e-15) for k in one)
    lone = spark.createDataFrame([(None, 1, 3, 3, 3), (None, 2, 5, 5, 5), (7, 3, 6, 6, 6)], "hid long, indx long, x long, y long, z long")
    cells, back = subhalo.spline_density(lone, 7, 5, 4096)
    assert {r["indx"] for r in back.collect()} == {1, 2, 3} and {r["hid"] for r in cells.collect()} == {None, 7}


def test_cells_of_wide_splines_are_summed_in_parts(monkeypatch):
    """r04 F3: cells that members reach are never all in memory, and the same in parts of space as together."""
    rng = np.random.default_rng(43)
    halo, q, h = np.repeat(np.arange(4), 10), rng.uniform(-9, 9, (40, 3)), rng.uniform(0.5, 3, 40)
    low, high = np.ceil(q - 2 * h[:, None]).astype(int), np.floor(q + 2 * h[:, None]).astype(int)

    def made():
        parts = list(subhalo._sums(halo, q, h, low, high))
        rows = [(int(a), *map(int, c), v) for a_, c_, v_ in parts for a, *c, v in zip(a_, *c_, v_)]
        assert len({r[:4] for r in rows}) == len(rows)
        return len(parts), {r[:4]: r[4] for r in rows}

    one, whole = made()
    monkeypatch.setattr(subhalo, "REACHED", 300)
    many, parts = made()
    assert one == 1 and many > 20 and parts.keys() == whole.keys() and all(np.isclose(parts[k], whole[k], rtol=1e-12) for k in whole)
    want = {}
    for a, p, r in zip(halo, q, h):
        for o in np.ndindex(33, 33, 33):
            if (d := float(np.linalg.norm(np.array(o) - 16 - p))) < 2 * r:
                key = (int(a), *(int(v) - 16 for v in o))
                s = d / r
                want[key] = want.get(key, 0) + (1 - 1.5 * s**2 + 0.75 * s**3 if s < 1 else 0.25 * (2 - s) ** 3) / (np.pi * r**3)
    assert want.keys() == whole.keys() and all(np.isclose(want[k], whole[k], rtol=1e-9, atol=1e-12) for k in want)


def test_pairs_of_ellipsoids_are_not_shuffled(spark, monkeypatch):
    """hosts of few subhalos are dealt whole, once, with the same pairs as by levels of cells."""
    rng = np.random.default_rng(22)
    rows = [(k, k % 3, *map(float, rng.random(3) * 100), float(10 ** rng.uniform(0, 1.3)), float(rng.uniform(0.1, 1)), float(rng.uniform(0.1, 1))) for k in range(120)]
    sub = spark.createDataFrame(rows, "id long, host long, x double, y double, z double, r double, q double, s double").repartition(4)
    monkeypatch.setattr(grouped, "SHARE", 20)
    assert by(ellipsoids.overlap_pairs(sub, 100.0), "host")
    whole, split = (sorted(map(tuple, ellipsoids.overlap_pairs(sub, 100.0, whole=w).collect())) for w in (2000, 10))
    assert whole == split and len(whole) > 5


def test_ellipsoids_of_a_host_merge_in_its_task(spark, monkeypatch):
    """r04 F1, F2: no graph of pairs, and the same sums as from one; subhalos without a host pass through."""
    rng = np.random.default_rng(41)
    rows = [(k, k % 7 if k % 10 else None, *map(float, rng.random(3) * 100), float(10 ** rng.uniform(0.6, 1.5)), float(rng.uniform(0.1, 1)), float(rng.uniform(0.1, 1)), k % 5) for k in range(200)]
    sub = spark.createDataFrame(rows, "id long, host long, x double, y double, z double, r double, q double, s double, mass long").repartition(4)
    monkeypatch.setattr(grouped, "SHARE", 20)
    assert by(ellipsoids.merged(sub, 100.0), "_deal")
    want = sorted(map(tuple, ellipsoids.merge_ellipsoids(sub, ellipsoids.overlap_pairs(sub, 100.0)).collect()), key=str)
    for whole in (2000, 25, 5):
        assert sorted(map(tuple, ellipsoids.merged(sub, 100.0, whole=whole).collect()), key=str) == want
    assert len(want) < 170 and sum(w[3] for w in want) == 200 and ellipsoids.merged(sub.limit(0), 100.0).count() == 0


def test_most_ellipsoids_need_no_loop_over_samples(monkeypatch):
    """r04 F6: what samples decide is the same as by loops over the points, for ellipsoids from balls to needles and plates."""
    rng = np.random.default_rng(42)
    n = 400
    axes = [np.linalg.qr(rng.normal(size=(n, 3, 3)))[0] for _ in "ij"]
    size = [10 ** rng.uniform(0, 1, (n, 1)) * np.concatenate([np.ones((n, 1)), 10 ** rng.uniform(-3, 0, (n, 2))], axis=1) for _ in "ij"]
    d = rng.normal(size=(n, 3)) * (size[0][:, :1] + size[1][:, :1]) / 3
    unit, want = ellipsoids.sphere_points(), []
    for k in range(n):
        inside = lambda p, t: (((p @ axes[t][k].T) / size[t][k]) ** 2).sum(axis=-1) <= 1  # noqa: E731, B023
        want.append(inside(d[k], 0) or inside(d[k] + (unit * size[1][k]) @ axes[1][k], 0).any() or inside((unit * size[0][k]) @ axes[0][k] - d[k], 1).any())
    calls = []
    monkeypatch.setattr(ellipsoids, "_reaches", lambda to, m, plain=ellipsoids._reaches: calls.append(len(to)) or plain(to, m))
    assert ellipsoids._overlap(d, *size, *axes).tolist() == list(map(bool, want)) and 50 < sum(want) < 300 and sum(calls) < 1.3 * n


def test_knn_of_small_groups_is_not_shuffled_twice(spark, monkeypatch):
    """F14, F15, F24."""
    df = spread_members(spark)
    monkeypatch.setattr(grouped, "SHARE", 20)
    assert by(knn_in_group(df, 5, 4096), "g")
    whole, split = (sorted(map(tuple, knn_in_group(df, 5, 4096, leaf=n).collect())) for n in (256, 16))
    assert whole == split and len(whole) > 400


def test_shells_of_small_halos_are_not_shuffled_twice(spark, monkeypatch):
    """whole halos in tasks and by cells; chains of links, ties and halos without a core."""
    rng = np.random.default_rng(23)
    rows = [(h, h * 1000 + k, *map(int, rng.integers(0, 300, 3)), None if k % 4 or h == 3 else h * 2 + k % 3) for h, n in ((1, 1), (2, 60), (3, 50), (4, 90)) for k in range(n)]
    df = spark.createDataFrame(rows, "hid long, indx long, x long, y long, z long, core long").repartition(3)
    shell, cores = df.filter("core is null"), df.filter("core is not null")
    monkeypatch.setattr(grouped, "SHARE", 20)
    assert by(subhalo.assign_shell(shell, cores, 30), "hid")
    whole, split = (sorted(map(tuple, subhalo.assign_shell(shell, cores, 30, whole=w).collect())) for w in (1000, 20))
    assert whole == split and 10 < len(whole) < 150


def test_first_observers_are_known_where_rows_are(spark):
    """no shuffle by particle, and the same first observers as by all that see it."""
    df = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(np.random.default_rng(24).integers(0, 16384, (400, 3)))], "indx long, x long, y long, z long")
    seen = cone.seen_by(df, cone.observer_lattice(spark, 16384), 16384, 960, 5000)
    assert not any("indx" in e for e in exchanges(seen))
    best = {}
    for r in cone.seen_by(df, cone.observer_lattice(spark, 16384), 16384, 960, 5000, first=False).collect():
        best[r["indx"]] = min(best.get(r["indx"], r["iobs"]), r["iobs"])
    assert {r["indx"]: r["iobs"] for r in seen.collect()} == best and len(best) > 300



def test_labels_of_a_dense_cluster_do_not_cost_its_pairs():
    """450 million pairs within a link's reach, and a few points between them and others."""
    rng = np.random.default_rng(25)
    pos = np.concatenate([rng.integers(0, 60, (30_000, 3)), [[59, 30, 30], [100, 30, 30], [139, 30, 30], [180, 30, 30]]]).astype(float)
    began = time.time()
    labels = fof.local_labels(np.arange(len(pos)) + 5, pos, 41.0)
    assert time.time() - began < 5 and set(labels.tolist()) == {5}
    assert fof.local_labels(np.arange(3), pos[-3:], 40.0).tolist() == [0, 0, 2]


def test_potentials_of_groups_of_a_leaf_are_summed_whole(spark, monkeypatch):
    """F16: groups of up to a leaf are dealt by group once, with or without a tree, with the same potentials as by tiles; null groups are left out."""
    monkeypatch.setattr(grouped, "SHARE", 20)
    df = spread_members(spark).filter("hid < 4").unionByName(spark.createDataFrame([(None, 1, 0, 0, 0)], "hid long, indx long, x long, y long, z long"))
    want = {r["indx"]: r["pe"] for r in halo.pair_potential(df, tile=7).collect()}
    for exact in (None, 10):
        out = halo.pair_potential(df, exact=exact)
        assert by(out, "hid")
        got = {r["indx"]: r["pe"] for r in out.collect()}
        assert len(got) == 43 and got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_families_of_cores_take_their_turns_whole(spark, monkeypatch):
    """families are dealt whole, once, with the same cores as by turns over many tasks; members without a core, cores without
    members and cores that the tree doesn't name keep their places."""
    monkeypatch.setattr(grouped, "SHARE", 20)
    rng = np.random.default_rng(23)
    rows = [(c, c * 1000 + k, *map(int, rng.normal(5 * (c % 10), 12, 3)), *map(int, rng.normal(0, 9, 3))) for c, n in ((10, 60), (11, 25), (12, 9), (13, 30), (20, 40), (31, 14), (32, 12), (50, 8)) for k in range(n)]
    df = spark.createDataFrame([*rows, *((None, k, 0, 0, 0, 0, 0, 0) for k in range(3))], "core long, indx long, x long, y long, z long, vx long, vy long, vz long").repartition(3)
    tree = spark.createDataFrame([(10, None), (11, 10), (12, 11), (13, 10), (20, None), (32, 33), (33, 31), (40, None)], "core long, parent long")
    one, two = (subhalo.unbind_cores(df, tree, 0.05, 6.0, whole=w) for w in (3000, 5))
    assert by(one, "family")
    got, want = ({r["indx"]: r["core"] for r in d.collect()} for d in (one, two))
    assert got == want and len(got) == len(rows) + 3
    moved = {(c, got[i]) for c, i, *_ in rows}
    assert {(32, 31), (12, None), (20, None), (10, 10), (31, 31), (50, 50)} <= moved and all(got[k] is None for k in range(3))
    for loop in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            subhalo.unbind_cores(df, spark.createDataFrame(loop, "core long, parent long"), 0.05, 6.0)
