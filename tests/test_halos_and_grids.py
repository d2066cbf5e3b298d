"""Halo properties, ellipsoids and grids against numpy."""

import numpy as np
from pyspark.sql import functions as F

from halospark.operators import ellipsoids, grid, halo, spectrum, subhalo
from halospark.operators.massfunc import mass_function


def members(spark, seed=0, n=40):
    rng = np.random.default_rng(seed)
    pos, vel = rng.normal(0, 10, (n, 3)) * [3, 2, 1], rng.normal(0, 1, (n, 3))
    rows = [(i % 2, i, *map(float, pos[i]), *map(float, vel[i])) for i in range(n)]
    return spark.createDataFrame(rows, "hid long, indx long, x double, y double, z double, vx double, vy double, vz double"), pos, vel


def test_potential_tiles_agree_with_numpy(spark):
    df, pos, _ = members(spark)
    for tile in (5, 2000):
        got = {r["indx"]: r["pe"] for r in halo.pair_potential(df, 0.1, tile=tile).collect()}
        for i in range(len(pos)):
            other = [j for j in range(len(pos)) if j != i and j % 2 == i % 2]
            want = -sum(1 / np.sqrt(((pos[i] - pos[j]) ** 2).sum() + 0.01) for j in other)
            assert abs(got[i] - want) < 1e-9


def test_far_cells_keep_the_potential_within_its_bound(spark):
    rng = np.random.default_rng(12)
    pos = np.concatenate([rng.normal(0, 10, (1500, 3)), rng.normal(40, 1, (700, 3)), np.full((60, 3), -25.0), [[300.0, 0, 0]]])
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pos)] + [(2, 9000 + i, float(i), 0.0, 0.0) for i in range(5)], "hid long, indx long, x double, y double, z double")
    d = pos[:, None] - pos[None]
    want = 1 / np.sqrt((d * d).sum(axis=2) + 0.01)
    np.fill_diagonal(want, 0)
    want = -want.sum(axis=1)
    for theta in (0.5, 0.2):
        got = {r["indx"]: r["pe"] for r in halo.pair_potential(df, 0.1, exact=100, theta=theta).collect()}
        off = np.abs(np.array([got[i] for i in range(len(pos))]) - want) / -want
        assert len(got) == len(pos) + 5 and off.max() <= theta**2 / (1 - theta) and off.mean() < 0.004 and off.max() > 0
    assert abs(got[9000] + sum(1 / np.sqrt(k * k + 0.01) for k in range(1, 5))) < 1e-9


def test_mass_function_of_one_mass(spark):
    for masses in ([7.0], [100.0] * 5):
        rows = mass_function(spark.createDataFrame([(m,) for m in masses], "mass double"), "mass", 4).collect()
        assert len(rows) == 4 and sum(r["n"] for r in rows) == len(masses) and rows[0]["cumulative"] == len(masses)
    assert mass_function(spark.createDataFrame([], "mass double"), "mass", 4).count() == 0


def test_deposits_agree_with_loops(spark):
    rng = np.random.default_rng(3)
    q, n = rng.random((50, 3)) * 8, 8
    df = spark.createDataFrame([(*map(float, p), float(k)) for k, p in enumerate(q)], "a double, b double, c double, v double")
    for scheme in ("ngp", "cic", "tsc"):
        want = np.zeros((n, n, n))
        for k, p in enumerate(q):
            if scheme == "tsc":
                parts = [[(int(np.floor(x + 0.5)) + d, 0.75 - f * f if d == 0 else 0.5 * (0.5 + d * f) ** 2) for d in (-1, 0, 1)] for x in p for f in [x - np.floor(x + 0.5)]]
            else:
                parts = [[(int(x), 1 - f), (int(x) + 1, f)] if scheme == "cic" else [(int(x), 1.0)] for x in p for f in [x - int(x)]]
            for i, u in parts[0]:
                for j, v in parts[1]:
                    for m, w in parts[2]:
                        want[i % n, j % n, m % n] += u * v * w * k
        got = np.zeros((n, n, n))
        for r in grid.deposit(df, n, {"x": F.col("a"), "y": F.col("b"), "z": F.col("c")}, scheme, F.col("v")).collect():
            got[r["ix"], r["iy"], r["iz"]] += r["value"]
        assert np.allclose(got, want)


def test_lone_and_coincident_members_have_no_density(spark):
    rows = [(1, 1, 5, 5, 5), (2, 2, 7, 7, 7), (2, 3, 7, 7, 7), (2, 4, 9, 7, 7)]
    got = {r["indx"]: r["density"] for r in halo.sph_density(spark.createDataFrame(rows, "hid long, indx long, x long, y long, z long"), 1, 4096).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and got[4] > 0


def test_shape_agrees_with_numpy(spark):
    df, pos, _ = members(spark, 1)
    for r in halo.shape(df).collect():
        p = pos[r["hid"] :: 2]
        d = np.sort(np.linalg.eigvalsh((p - p.mean(0)).T @ (p - p.mean(0))))[::-1]
        assert np.allclose([r["d1"], r["d2"], r["d3"]], d) and np.isclose(r["q"], np.sqrt(d[1] / d[0])) and np.isclose(r["s"], np.sqrt(d[2] / d[0]))
        axes = np.array(r["axes"])
        assert np.isclose(np.linalg.det(axes), 1) and np.allclose(axes @ axes.T, np.eye(3))
    point = spark.createDataFrame([(1, 1, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0)], df.schema)
    assert halo.shape(point).first()["q"] is None


def test_halo_properties_has_one_row_a_halo(spark):
    rows = halo.halo_properties(members(spark, 2)[0], 0.1).collect()
    assert sorted(r["hid"] for r in rows) == [0, 1] and all(0 < r["q"] <= 1 and r["mbp"] % 2 == r["hid"] for r in rows)


def test_overlap_of_ellipsoids(spark):
    rows = [(1, 1, 0.0, 0.0, 0.0, 4.0, 1.0, 1.0, 5), (2, 1, 7.0, 0.0, 0.0, 4.0, 1.0, 1.0, 6), (3, 1, 0.0, 6.0, 0.0, 4.0, 0.3, 1.0, 7), (4, 2, 1.0, 0.0, 0.0, 4.0, 1.0, 1.0, 8), (5, 1, 98.0, 0.0, 0.0, 4.0, 1.0, 1.0, 9)]
    sub = spark.createDataFrame(rows, "id long, host long, x double, y double, z double, r double, q double, s double, mass long")
    pairs = ellipsoids.overlap_pairs(sub, 100.0)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 5)}  # 3 is flat towards 1, 4 has another host, 5 is across the face
    got = {(r["host"], r["label"]): (r["mass"], r["n"]) for r in ellipsoids.merge_ellipsoids(sub, pairs).collect()}
    assert got == {(1, 1): (20, 3), (1, 3): (7, 1), (2, 4): (8, 1)}


def test_overlap_of_turned_ellipsoids_of_all_sizes(spark):
    """Random axes and radii from a hundredth to a third of the box, against loops over the samples with rotation matrices."""
    rng = np.random.default_rng(13)
    rows = []
    for k in range(90):
        axes = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        rows.append((k, k % 2, *map(float, rng.random(3) * 100), float(10 ** rng.uniform(0, 1.5)), float(rng.uniform(0.1, 1)), float(rng.uniform(0.1, 1)), 1, *(axes[:, n].tolist() for n in range(3))))
    sub = spark.createDataFrame(rows, "id long, host long, x double, y double, z double, r double, q double, s double, mass long, a array<double>, b array<double>, c array<double>")
    got, want, unit = {tuple(r) for r in ellipsoids.overlap_pairs(sub, 100.0).collect()}, set(), ellipsoids.sphere_points()
    for i, *_ in rows:
        for j in range(i + 2, len(rows), 2):
            one, two = rows[i], rows[j]
            d = np.subtract(two[2:5], one[2:5])
            d -= 100 * np.round(d / 100)
            (ri, si), (rj, sj) = ((np.array(o[9:12]).T, o[5] * np.array([1, o[6], o[7]])) for o in (one, two))
            inside = lambda p, r, s: (((p @ r) / s) ** 2).sum(axis=-1) <= 1
            if (d @ d) ** 0.5 <= one[5] + two[5] and (inside(d + (unit * sj) @ rj.T, ri, si).any() or inside((unit * si) @ ri.T - d, rj, sj).any() or inside(d, ri, si)):
                want.add((i, j))
    assert got == want and len(want) > 15 and ellipsoids.overlap_pairs(sub.limit(0), 100.0).count() == 0


def test_deposits_keep_mass_and_spectrum_keeps_power(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in rng.integers(0, 8 * 16, (200, 3)) / 16], "x double, y double, z double")
    q = {c: F.col(c) for c in "xyz"}
    for scheme in ("ngp", "cic", "tsc"):
        g = grid.deposit(df, 8, q, scheme)
        assert g.agg(F.sum("value")).first()[0] == 200.0
    dense = np.zeros((8, 8, 8))
    for r in g.collect():
        dense[r["ix"], r["iy"], r["iz"]] = r["value"]
    f = np.fft.fftn(dense)
    for r in spectrum.fourier_modes(g, 8).collect():
        assert np.isclose(r["re"] + 1j * r["im"], f[r["kx"], r["ky"], r["kz"]])
    total = spectrum.power_spectrum(spectrum.fourier_modes(g, 8), 8, window=0, hermitian=True).agg(F.sum(F.col("pk") * F.col("weight"))).first()[0]
    below = (np.abs(f) ** 2).sum() / 8**6 - np.abs(f[0, 0, 0]) ** 2 / 8**6
    assert total <= below * 1.0000001 and total > 0.9 * below


def test_contours_agree_with_floods(spark):
    """A cell is of the peak that its denser neighbours lead to; a peak's saddle is the highest level at which it is connected with a higher peak."""
    rng = np.random.default_rng(6)
    cells = {(x, y, z): float(d) for (x, y, z), d in zip({tuple(map(int, p)) for p in rng.integers(0, 6, (120, 3))}, rng.permutation(200) + 1.0)}
    df = spark.createDataFrame([(7, *c, d) for c, d in cells.items()] + [(8, *c, d) for c, d in cells.items()], "hid long, ix long, iy long, iz long, density double").repartition(5)
    runs = [sorted(map(tuple, subhalo.separate_contours(df, whole=w, together=t).collect())) for w, t in ((1000, 1000), (10, 3))]  # whole, split over tasks with rounds for the graph of peaks
    assert runs[0] == runs[1]
    got = {(r["ix"], r["iy"], r["iz"]): r for r in subhalo.separate_contours(df, whole=1000).filter("hid = 7").collect()}
    dense = {c: d for c, d in cells.items() if d > 1.5}
    around = lambda c, level: [n for a in (-1, 0, 1) for b in (-1, 0, 1) for e in (-1, 0, 1) if (n := (c[0] + a, c[1] + b, c[2] + e)) != c and dense.get(n, -1) >= level]
    peaks = {c for c, d in dense.items() if all(dense[n] < d for n in around(c, 0))}
    assert set(got) == set(dense) and len({r["peak"] for r in got.values()}) == len(peaks)
    for c in dense:
        up = c
        while up not in peaks:
            up = max(around(up, 0), key=dense.get)
        assert got[c]["peak"] == got[up]["peak"]
    for p in peaks:
        want = None
        for level in sorted({d for d in dense.values() if d < dense[p]}, reverse=True):
            seen, todo = {p}, [p]
            while todo:
                for n in around(todo.pop(), level):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            if any(dense[q] > dense[p] for q in seen & peaks):
                want = level
                break
        assert got[p]["saddle"] == want


def test_contours_of_one_large_halo_over_many_tasks(spark):
    """Ties, plateaus and one halo of many cells: split over tasks it is as it is in one."""
    rng = np.random.default_rng(7)
    places = {tuple(map(int, p)) for p in rng.integers(0, 24, (9000, 3))}
    df = spark.createDataFrame([(1, *c, float(rng.integers(1, 40))) for c in places] + [(2, 0, 0, 0, 5.0)], "hid long, ix long, iy long, iz long, density double").repartition(6)
    one = sorted(map(tuple, subhalo.separate_contours(df).collect()), key=str)
    assert sorted(map(tuple, subhalo.separate_contours(df, whole=100, together=20_000).collect()), key=str) == one
    assert len({r[5] for r in one}) > 50 and (2, 0, 0, 0, 5.0, 0, None) in one
    assert subhalo.separate_contours(df.limit(0)).count() == 0


def test_unbinding_goes_from_the_inside_out(spark):
    """Whole cores in tasks or by aggregations; the inner core's loss is the outer's gain, so the order shows."""
    rng = np.random.default_rng(9)
    rows = []
    for core, centre, spread, n in ((10, 0.0, 30.0, 120), (11, 60.0, 4.0, 60), (12, 66.0, 1.5, 25)):
        at = rng.normal(0, spread, (n, 3)) + [centre, 0, 0]
        rows += [(core, core * 1000 + k, *map(float, at[k]), *map(float, rng.normal(0, 2 + 30 * (k % 9 == 0), 3))) for k in range(n)]
    rows += [(13, 13_000 + k, float(k % 3), 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(3)] + [(None, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "core long, indx long, x double, y double, z double, vx double, vy double, vz double")
    tree = spark.createDataFrame([(10, None), (11, 10), (12, 11)], "core long, parent long")

    def loops(order):
        """The same, core after core in the given order."""
        core = {r[1]: r[0] for r in rows}
        at = {r[1]: np.array(r[2:]) for r in rows}
        shell = lambda r2: int(np.floor(4 * np.log2(max(r2, 1e-12))))
        mine = lambda c: sorted(i for i, k in core.items() if k == c)
        mean = lambda ids: np.mean([at[i] for i in ids], axis=0)
        for c, parent in order:
            now, bg = mine(c), None
            if parent and mine(parent):
                centre = mean(mine(parent))
                to = shell(((mean(now) - centre)[:3] ** 2).sum())
                n = sum(shell(((at[i] - centre)[:3] ** 2).sum()) <= to for i in mine(parent))
                bg = n or None
            ids = now
            for _ in range(4):
                m = mean(ids)
                s = {i: shell(((at[i] - m)[:3] ** 2).sum()) for i in ids}
                if bg is not None:
                    lim = max((j for j in s.values() if sum(k <= j for k in s.values()) >= 3 * bg * 2 ** (3 * (j - to) / 8)), default=-999)
                    ids = [i for i in ids if s[i] <= lim]
                e = {i: 0.5 * (((at[i] - m)[3:] + 0.05 * (at[i] - m)[:3]) ** 2).sum() - 6.0 * sum(1 / np.sqrt(((at[i] - at[j])[:3] ** 2).sum() + 0.01) for j in ids if j != i) for i in ids}
                ids = [i for i in ids if e[i] <= 0]
            for i in set(now) - set(ids):
                core[i] = parent
        return core

    want = loops([(12, 11), (11, 10), (10, None)])
    got = [{r["indx"]: r["core"] for r in subhalo.unbind_cores(df, tree, 0.05, 6.0, whole=w).collect()} for w in (3000, 30)]
    assert got[0] == got[1] == want and len(got[0]) == len(rows)
    assert {want[r[1]] for r in rows if r[0] == 12} >= {12, 11} and want != loops([(10, None), (11, 10), (12, 11)])
