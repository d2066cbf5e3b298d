"""Queries for pairs, groups and halo properties."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import fof, halo, subhalo
from ..operators.grid import deposit_adaptive, deposit_w4
from ..operators.massfunc import mass_function
from ..operators.pairs import fixed_radius_pairs, knn_in_group
from ..scratch import cut
from .base import CENTRED, LABELS, PAIRS, near, query
from .fixtures import BOX, CLUMPS, LINK, MIN_NP, clumps, particles


@query(f"WITH {PAIRS} SELECT i, j, r2 FROM pr WHERE i < j")
def j1_fixed_radius_pairs(spark, sf):
    return fixed_radius_pairs(particles(spark, sf), LINK, BOX)


KNN = f"c AS MATERIALIZED ({CLUMPS}), kn AS MATERIALIZED (SELECT hid, id, other, r2, row_number() OVER (PARTITION BY hid, id ORDER BY r2, other) AS rank FROM (SELECT a.hid, a.indx AS id, b.indx AS other, {near('a', 'b')} AS r2 FROM c a JOIN c b ON a.hid = b.hid AND a.indx <> b.indx) QUALIFY rank <= 5)"


@query(f"WITH {KNN} SELECT hid, id, other, r2, CAST(rank AS INTEGER) AS rank FROM kn")
def j2_knn(spark, sf):
    return knn_in_group(clumps(spark, sf), 5, BOX)


def _places(spark, sf):
    """The snapshot's places, written, as grouping reads them several times."""
    return cut(particles(spark, sf).select("indx", "x", "y", "z"))


@query(f"WITH RECURSIVE {LABELS} SELECT indx, label FROM lab")
def g1_fof_groups(spark, sf):
    return fof.fof_groups(_places(spark, sf), LINK, BOX)


@query(f"WITH RECURSIVE {LABELS} SELECT z//2048 AS slab, label, CAST(max(CASE WHEN z%2048 <= {LINK} THEN 1 ELSE 0 END) + 2*max(CASE WHEN (z//2048+1)*2048-z <= {LINK} THEN 1 ELSE 0 END) AS INTEGER) AS class FROM p JOIN lab USING (indx) GROUP BY 1, 2")
def g2_boundary_class(spark, sf):
    p = _places(spark, sf)
    return fof.boundary_class(p, fof.fof_groups(p, LINK, BOX), LINK, 2048)


@query(f"WITH RECURSIVE {LABELS} SELECT label, np FROM big")
def g3_merge_boundary_groups(spark, sf):
    """The same groups from small blocks, most of which are cut by faces."""
    return fof.fof_groups(_places(spark, sf), LINK, BOX, blocks=16).groupBy("label").agg(F.count("*").alias("np")).filter(F.col("np") >= MIN_NP)


def _unwrap_sql(source: str) -> str:
    out, last = "", source
    for c in "xyz":
        rest = ", ".join(["hid", "indx", *(v for v in "xyz" if v != c), "vx", "vy", "vz"])
        out += f"""t{c} AS (SELECT hid FROM {last} GROUP BY 1 HAVING min({c}) <= {LINK} AND max({c}) >= {BOX - LINK}),
u{c} AS MATERIALIZED (SELECT {rest}, CASE WHEN hid IN (SELECT hid FROM t{c}) AND max(gap) OVER (PARTITION BY hid ORDER BY {c}, indx) = 1 THEN {c} - {BOX} ELSE {c} END AS {c}
  FROM (SELECT *, CASE WHEN {c} - lag({c}) OVER (PARTITION BY hid ORDER BY {c}, indx) > {1.5 * LINK} THEN 1 ELSE 0 END AS gap FROM {last})),
"""
        last = f"u{c}"
    return out


HALOS = f"""{LABELS}, hm AS MATERIALIZED (SELECT label AS hid, p.* FROM p JOIN lab USING (indx) WHERE label IN (SELECT label FROM big)),
{_unwrap_sql('hm')}u AS (SELECT * FROM uz)"""


def fof_members(spark, sf):
    """Members of FoF halos of at least MIN_NP, not cut by the box's faces; hid is the label."""
    p = particles(spark, sf)
    groups = fof.fof_groups(_places(spark, sf), LINK, BOX)
    big = groups.groupBy("label").agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_NP).select("label")
    members = p.join(groups.join(big, "label", "left_semi").withColumnRenamed("label", "hid"), "indx")
    return fof.unwrap(cut(members.select("hid", "indx", "x", "y", "z", "vx", "vy", "vz")), LINK, BOX)


@query(f"WITH RECURSIVE {HALOS} SELECT hid, indx, x, y, z FROM u")
def g4_unwrap_halo(spark, sf):
    return fof_members(spark, sf).select("hid", "indx", "x", "y", "z")


@query(f"SELECT pk, np, row_number() OVER (ORDER BY np DESC, pk) - 1 AS hid FROM (SELECT hid AS pk, CAST(count(*) AS BIGINT) AS np FROM ({CLUMPS}) GROUP BY 1)")
def g6_number_halos(spark, sf):
    sizes = clumps(spark, sf).groupBy(F.col("hid").alias("pk")).agg(F.count("*").alias("np"))
    return fof.dense_numbers(sizes, [F.desc("np"), F.col("pk")], "hid").select("pk", "np", "hid")


_COLS = ("x", "y", "z", "vx", "vy", "vz")


@query(f"WITH RECURSIVE {HALOS} SELECT hid, CAST(count(*) AS BIGINT) AS np, {', '.join(f'CAST(sum({c}) AS BIGINT) AS s{c}, sum({c})/CAST(count(*) AS DOUBLE) AS {c}' for c in _COLS)} FROM u GROUP BY 1")
def a1_halo_catalog(spark, sf):
    return halo.catalog(fof_members(spark, sf))


@query(f"SELECT hid, {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in 'xyz')} FROM ({CLUMPS}) GROUP BY 1")
def a2_halo_bbox(spark, sf):
    return halo.bbox(clumps(spark, sf))


_KE = "0.5e0*(" + " + ".join(f"(dv{c} + 0.7e0*d{c})*(dv{c} + 0.7e0*d{c})" for c in "xyz") + ")"
_PE = f"pe AS MATERIALIZED (SELECT a.hid, a.indx, -sum(1/sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2)+pow(a.z-b.z, 2)+0.01e0)) AS pe FROM c a JOIN c b ON a.hid = b.hid AND a.indx <> b.indx GROUP BY 1, 2)"


@query(f"WITH {CENTRED} SELECT hid, round(sqrt(2*avg({_KE})), 6) AS sigv FROM d GROUP BY 1")
def a3_velocity_dispersion(spark, sf):
    return halo.velocity_dispersion(clumps(spark, sf), 0.7).select("hid", F.round("sigv", 6).alias("sigv"))


@query(f"WITH {CENTRED}, l AS (SELECT hid, count(*) AS np, sum(dy*dvz-dz*dvy) AS lx, sum(dz*dvx-dx*dvz) AS ly, sum(dx*dvy-dy*dvx) AS lz FROM d GROUP BY 1) SELECT hid, CAST(round(lx*np) AS BIGINT) AS lx, CAST(round(ly*np) AS BIGINT) AS ly, CAST(round(lz*np) AS BIGINT) AS lz FROM l")
def a4_angular_momentum(spark, sf):
    """Times the number of members, which makes whole numbers of the components."""
    c = clumps(spark, sf)
    both = halo.angular_momentum(c).join(c.groupBy("hid").agg(F.count("*").alias("np")), "hid")
    return both.select("hid", *(F.round(F.col(v) * F.col("np")).cast("long").alias(v) for v in ("lx", "ly", "lz")))


def _bound(spark, sf):
    c = clumps(spark, sf)
    ke = halo.kinetic(c, 0.7).select("hid", "indx", "ke")
    return ke.join(halo.pair_potential(c).select("hid", "indx", "pe"), ["hid", "indx"])


@query(f"""WITH {CENTRED}, {_PE}, l AS (SELECT hid, sum(dy*dvz-dz*dvy) AS lx, sum(dz*dvx-dx*dvz) AS ly, sum(dx*dvy-dy*dvx) AS lz FROM d GROUP BY 1),
e AS (SELECT hid, CAST(count(*) AS BIGINT) AS np, sum({_KE}/1000000000) + sum(pe)/2 AS e FROM d JOIN pe USING (hid, indx) GROUP BY 1)
SELECT hid, CASE WHEN e <= 0 THEN round(sqrt(lx*lx+ly*ly+lz*lz)*sqrt(-e)/pow(np, 2.5), 4) END AS spin FROM l JOIN e USING (hid)""")
def a4_spin_parameter(spark, sf):
    bound = _bound(spark, sf).withColumn("ke", F.col("ke") / 1000000000)
    out = halo.spin_parameter(clumps(spark, sf), halo.virial_ratio(bound), 1.0, 1.0)
    kept = bound.select("hid").distinct()
    return out.join(kept, "hid").select("hid", F.round("spin", 4).alias("spin"))


@query(f"WITH {CENTRED} SELECT hid, {', '.join(f'round(sum(d{a}*d{b}), 3) + 0 AS m{a}{b}' for a, b in ('xx', 'yy', 'zz', 'xy', 'yz', 'xz'))}, CAST(count(*) AS BIGINT) AS np FROM d GROUP BY 1")
def a5_shape_moments(spark, sf):
    m = halo.shape_moments(clumps(spark, sf))
    return m.select("hid", *((F.round(f"m{c}", 3) + 0).alias(f"m{c}") for c in ("xx", "yy", "zz", "xy", "yz", "xz")), "np")


@query(f"WITH {CENTRED} SELECT hid, CAST(round(sum(dx*dx+dy*dy+dz*dz)*any_value(np)) AS BIGINT) AS trace FROM d GROUP BY 1")
def a5_shape_eigenvalues(spark, sf):
    """The sum of the eigenvalues is the trace of the moments; q, s and axes are tested apart."""
    return halo.shape(clumps(spark, sf)).select("hid", F.round((F.col("d1") + F.col("d2") + F.col("d3")) * F.col("np")).cast("long").alias("trace"))


#: Eigenvalues of the moments in closed form: e(hid, np, d1, d2, d3), and i(hid, ...), the inverse times the determinant.
EIGEN = f"""{CENTRED}, m AS MATERIALIZED (SELECT hid, any_value(np) AS np, sum(dx*dx) AS xx, sum(dy*dy) AS yy, sum(dz*dz) AS zz, sum(dx*dy) AS xy, sum(dy*dz) AS yz, sum(dx*dz) AS xz FROM d GROUP BY 1),
t AS (SELECT *, (xx+yy+zz)/3e0 AS t, sqrt((pow(xx-(xx+yy+zz)/3e0, 2) + pow(yy-(xx+yy+zz)/3e0, 2) + pow(zz-(xx+yy+zz)/3e0, 2) + 2*(xy*xy+yz*yz+xz*xz))/6e0) AS p FROM m),
a AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1e0, least(1e0, ((xx-t)*((yy-t)*(zz-t)-yz*yz) - xy*(xy*(zz-t)-yz*xz) + xz*(xy*yz-(yy-t)*xz))/(2*p*p*p))))/3e0 ELSE 0e0 END AS phi FROM t),
e AS MATERIALIZED (SELECT *, t+2*p*cos(phi) AS d1, greatest(0e0, t+2*p*cos(phi+{2 * math.pi / 3!r}e0)) AS d3, greatest(0e0, t-2*p*cos(phi)-2*p*cos(phi+{2 * math.pi / 3!r}e0)) AS d2 FROM a)"""


@query(f"WITH {EIGEN} SELECT hid, np, CASE WHEN np > 1 THEN round(sqrt(d2/d1), 3) END AS q, CASE WHEN np > 1 THEN round(sqrt(d3/d1), 3) END AS s, CASE WHEN np > 1 THEN round(d1, 1) ELSE 0e0 END AS d1 FROM e")
def a5_shape(spark, sf):
    """The axes are compared with numpy's, as their signs are free."""
    return halo.shape(clumps(spark, sf)).select("hid", "np", F.round("q", 3).alias("q"), F.round("s", 3).alias("s"), F.when(F.col("np") > 1, F.round("d1", 1)).otherwise(0.0).alias("d1"))


@query(f"WITH {CENTRED}, {_PE} SELECT hid, indx, round(pe, 6) AS pe FROM pe UNION ALL SELECT hid, indx, 0e0 FROM d WHERE np = 1")
def a6_pair_potential(spark, sf):
    return halo.pair_potential(clumps(spark, sf)).select("hid", "indx", (F.round("pe", 6) + 0.0).alias("pe"))


@query(f"WITH {CENTRED}, {_PE}, e AS (SELECT hid, indx, round({_KE} + coalesce(pe, 0), 3) AS e FROM d LEFT JOIN pe USING (hid, indx)) SELECT hid, indx AS mbp, e FROM (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY e, indx) AS rn FROM e) WHERE rn = 1")
def a7_most_bound_particle(spark, sf):
    return halo.most_bound(_bound(spark, sf), F.round(F.col("ke") + F.col("pe"), 3))


@query(f"WITH {CENTRED}, {_PE} SELECT hid, CAST(count(*) AS BIGINT) AS np, CASE WHEN count(pe) > 0 THEN round(2*sum({_KE})/(sum(pe)/2) + 1, 2) END AS kw, round(sum({_KE}) + coalesce(sum(pe), 0)/2, 2) AS total_energy FROM d LEFT JOIN pe USING (hid, indx) GROUP BY 1")
def a8_virial_ratio(spark, sf):
    return halo.virial_ratio(_bound(spark, sf)).select("hid", "np", F.round("kw", 2).alias("kw"), F.round("total_energy", 2).alias("total_energy"))


@query(f"WITH {CENTRED} SELECT hid, round(r, 6) AS radius FROM (SELECT hid, np, r, row_number() OVER (PARTITION BY hid ORDER BY r, indx) AS rn FROM (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS r FROM d)) WHERE rn = ceil(0.98e0*np)")
def a9_halo_radius(spark, sf):
    return halo.radius_of(clumps(spark, sf)).select("hid", F.round("radius", 6).alias("radius"))


#: The squared ellipsoidal distance is the largest eigenvalue times the distance in the inverse of the moments.
RADII = f"""{EIGEN}, f AS (SELECT *, xx*(yy*zz-yz*yz) - xy*(xy*zz-yz*xz) + xz*(xy*yz-yy*xz) AS det FROM e WHERE np > 1 AND d3/d1 >= 1e-10),
r AS (SELECT hid, indx, f.np, sqrt(greatest(0e0, d1*(dx*dx*(yy*zz-yz*yz) + dy*dy*(xx*zz-xz*xz) + dz*dz*(xx*yy-xy*xy) + 2*dx*dy*(xz*yz-xy*zz) + 2*dx*dz*(xy*yz-xz*yy) + 2*dy*dz*(xy*xz-xx*yz))/det)) AS r FROM d JOIN f USING (hid))"""


@query(f"WITH {RADII} SELECT hid, round(r, 2) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY r, indx) AS rn FROM r) WHERE rn = ceil(0.98*np)")
def a9_ellipsoidal_radius(spark, sf):
    return halo.ellipsoidal_radius(clumps(spark, sf)).select("hid", F.round("radius", 2).alias("radius"))


_TOTALS = {"x": 3, "y": 3, "z": 3, "vx": 3, "vy": 3, "vz": 3, "sigv": 4, "rotation": 1, "ux": 4, "uy": 4, "uz": 4, "kw": 1, "total_energy": 1, "spin": 4, "q": 3, "s": 3, "radius": 3}


@query(f"""WITH {EIGEN}, {_PE}, b AS MATERIALIZED (SELECT d.hid, d.indx, {_KE} AS ke, coalesce(pe, 0) AS pe FROM d LEFT JOIN pe USING (hid, indx)),
en AS (SELECT hid, 2*avg(ke) AS s2, CASE WHEN sum(pe) <> 0 THEN 2*sum(ke)/(sum(pe)/2) + 1 END AS kw, sum(ke) + sum(pe)/2 AS total_energy FROM b GROUP BY 1),
l AS (SELECT *, sqrt(lx*lx+ly*ly+lz*lz) AS rotation FROM (SELECT hid, sum(dy*dvz-dz*dvy) AS lx, sum(dz*dvx-dx*dvz) AS ly, sum(dx*dvy-dy*dvx) AS lz FROM d GROUP BY 1)),
ra AS (SELECT hid, r FROM (SELECT hid, np, sqrt(dx*dx+dy*dy+dz*dz) AS r, row_number() OVER (PARTITION BY hid ORDER BY sqrt(dx*dx+dy*dy+dz*dz), indx) AS rn FROM d) WHERE rn = ceil(0.98*np)),
h AS (SELECT hid, mean.np, CAST(mean.np AS DOUBLE) AS mass, mx AS x, my AS y, mz AS z, mvx AS vx, mvy AS vy, mvz AS vz, sqrt(s2) AS sigv, rotation, CASE WHEN rotation > 0 THEN lx/rotation END AS ux, CASE WHEN rotation > 0 THEN ly/rotation END AS uy,
  CASE WHEN rotation > 0 THEN lz/rotation END AS uz, kw, total_energy, CASE WHEN total_energy <= 0 THEN rotation*sqrt(-total_energy)/pow(mean.np, 2.5) END AS spin, CASE WHEN mean.np > 1 THEN sqrt(d2/d1) END AS q, CASE WHEN mean.np > 1 THEN sqrt(d3/d1) END AS s, r AS radius
  FROM mean JOIN en USING (hid) JOIN l USING (hid) JOIN e USING (hid) JOIN ra USING (hid))
SELECT hid, np, mass, {', '.join(f'round({c}, {k}) + 0 AS {c}' for c, k in _TOTALS.items())} FROM h""")
def a10_halo_properties(spark, sf):
    """All but the most bound member, which has a query of its own."""
    out = halo.halo_properties(clumps(spark, sf), 0.7)
    return out.select("hid", "np", "mass", *((F.round(c, k) + 0.0).alias(c) for c, k in _TOTALS.items()))


_W4 = "CASE WHEN {q} < 1 THEN 1 - 1.5e0*{q}*{q} + 0.75e0*{q}*{q}*{q} WHEN {q} < 2 THEN 0.25e0*(2-{q})*(2-{q})*(2-{q}) ELSE 0 END / (pi()*h*h*h)"
DENSITY = f"{KNN}, hh AS (SELECT hid, id, sqrt(max(r2))/2 AS h FROM kn GROUP BY 1, 2), dn AS MATERIALIZED (SELECT c.hid, c.indx, density FROM c LEFT JOIN (SELECT hid, id AS indx, round((sum({_W4.format(q='(sqrt(r2)/h)')}) + 1/(pi()*any_value(h*h*h)))*1000000, 3) AS density FROM kn JOIN hh USING (hid, id) WHERE h > 0 GROUP BY 1, 2) USING (hid, indx))"


def _density(spark, sf):
    return halo.sph_density(clumps(spark, sf), 5, BOX).withColumn("density", F.round(F.col("density") * 1000000, 3))


@query(f"WITH {DENSITY} SELECT hid, indx, density FROM dn")
def a11_sph_density(spark, sf):
    return _density(spark, sf)


@query(f"WITH {DENSITY} SELECT hid, indx, density, x, y, z FROM (SELECT dn.*, x, y, z, row_number() OVER (PARTITION BY dn.hid ORDER BY density DESC NULLS LAST, indx) AS rn FROM dn JOIN c USING (hid, indx)) WHERE rn = 1")
def a12_density_peak_center(spark, sf):
    return halo.density_peak(clumps(spark, sf), _density(spark, sf))


@query(f"""WITH c AS (SELECT hid, avg(x)/256 AS qx, avg(y)/256 AS qy, avg(z)/256 AS qz FROM ({CLUMPS}) GROUP BY 1), o AS (SELECT unnest(range(-2, 3)) AS o),
w AS (SELECT ix, iy, iz, sqrt(pow(ix-qx, 2)+pow(iy-qy, 2)+pow(iz-qz, 2)) AS r FROM (SELECT c.*, CAST(floor(qx) AS BIGINT)+a.o AS ix, CAST(floor(qy) AS BIGINT)+b.o AS iy, CAST(floor(qz) AS BIGINT)+e.o AS iz FROM c, o a, o b, o e) WHERE ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND 63 AND iz BETWEEN 0 AND 63)
SELECT ix, iy, iz, round(sum({_W4.format(q='r').replace('h*h*h', '1')}), 7) AS value FROM w WHERE r < 2 GROUP BY 1, 2, 3""")
def a13_deposit_w4(spark, sf):
    centres = clumps(spark, sf).groupBy("hid").agg(*((F.avg(c) / 256).alias(f"q{c}") for c in "xyz"))
    out = deposit_w4(centres, 64, 2, {c: F.col(f"q{c}") for c in "xyz"}, F.lit(1.0))
    return out.withColumn("value", F.round("value", 7))


MF = """lim AS (SELECT min(lm) AS lo, max(lm) AS hi FROM hl),
b AS (SELECT bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN lm = hi THEN {nbin}-1 ELSE CAST(floor((lm-lo)/((hi-lo)/{nbin})) AS BIGINT) END AS bin FROM hl, lim) GROUP BY 1),
f AS (SELECT t.bin, coalesce(n, 0) AS n, (pow(10e0, lo+t.bin*((hi-lo)/{nbin})) + pow(10e0, lo+(t.bin+1)*((hi-lo)/{nbin})))*0.5e0 AS mass, pow(10e0, lo+(t.bin+1)*((hi-lo)/{nbin})) - pow(10e0, lo+t.bin*((hi-lo)/{nbin})) AS w FROM (SELECT unnest(range({nbin})) AS bin) t LEFT JOIN b USING (bin), lim)
SELECT bin, n, round(mass, 3) AS mass, round(n*mass*ln(10e0)/w, 6) AS dndlogm, round((n+sqrt(n))*mass*ln(10e0)/w, 6) AS hi, round((n-sqrt(n))*mass*ln(10e0)/w, 6) AS lo, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS cumulative FROM f"""


def rounded(mf):
    return mf.select("bin", "n", F.round("mass", 3).alias("mass"), *(F.round(c, 6).alias(c) for c in ("dndlogm", "hi", "lo")), "cumulative")


@query(f"WITH RECURSIVE {LABELS}, hl AS (SELECT log10(CAST(np AS DOUBLE)) AS lm FROM big), {MF.format(nbin=10)}")
def a23_mass_function(spark, sf):
    """Flagship: snapshot to groups to catalogue to mass function."""
    sizes = fof.fof_groups(_places(spark, sf), LINK, BOX).groupBy("label").agg(F.count("*").alias("np")).filter(F.col("np") >= MIN_NP)
    return rounded(mass_function(sizes, "np", 10))


@query(f"WITH c AS ({CLUMPS}), cl AS (SELECT hid, ix, iy, iz, sum(w) AS density FROM (SELECT hid, x//16 + a.o AS ix, y//16 + b.o AS iy, z//16 + e.o AS iz, abs(1-a.o-(x%16)/16e0)*abs(1-b.o-(y%16)/16e0)*abs(1-e.o-(z%16)/16e0) AS w FROM c, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o), (VALUES (0), (1)) e(o)) GROUP BY 1, 2, 3, 4) SELECT hid, ix, iy, iz, density FROM cl")
def h1_halo_density_grid(spark, sf):
    return subhalo.halo_density(clumps(spark, sf), 16)[0]


@query(f"""WITH c AS ({CLUMPS}), cl AS MATERIALIZED (SELECT hid, ix, iy, iz, sum(w) AS density FROM (SELECT hid, x//64 + a.o AS ix, y//64 + b.o AS iy, z//64 + e.o AS iz, abs(1-a.o-(x%64)/64e0)*abs(1-b.o-(y%64)/64e0)*abs(1-e.o-(z%64)/64e0) AS w FROM c, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o), (VALUES (0), (1)) e(o)) GROUP BY 1, 2, 3, 4)
SELECT hid, ix, iy, iz, density FROM cl a WHERE density > 1.5 AND NOT EXISTS (SELECT 1 FROM cl b WHERE b.hid = a.hid AND b.ix BETWEEN a.ix-1 AND a.ix+1 AND b.iy BETWEEN a.iy-1 AND a.iy+1 AND b.iz BETWEEN a.iz-1 AND a.iz+1 AND (b.ix, b.iy, b.iz) <> (a.ix, a.iy, a.iz) AND b.density >= a.density)""")
def h2_density_peaks(spark, sf):
    return subhalo.density_peaks(subhalo.halo_density(clumps(spark, sf), 64)[0])


#: Cells numbered in a halo from the densest on; a cell points to its densest neighbour; floods from each peak over the cells up to each number.
@query(f"""WITH RECURSIVE c AS ({CLUMPS}), cl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY density DESC, ix, iy, iz) AS k FROM (SELECT hid, ix, iy, iz, sum(w) AS density FROM (SELECT hid, x//64 + a.o AS ix, y//64 + b.o AS iy, z//64 + e.o AS iz, abs(1-a.o-(x%64)/64e0)*abs(1-b.o-(y%64)/64e0)*abs(1-e.o-(z%64)/64e0) AS w FROM c, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o), (VALUES (0), (1)) e(o)) GROUP BY 1, 2, 3, 4 HAVING sum(w) > 1.5)),
nb AS MATERIALIZED (SELECT a.hid, a.k, b.k AS j FROM cl a JOIN cl b ON a.hid = b.hid AND a.k <> b.k AND abs(a.ix-b.ix) <= 1 AND abs(a.iy-b.iy) <= 1 AND abs(a.iz-b.iz) <= 1),
up AS MATERIALIZED (SELECT hid, k, min(j) AS j FROM nb WHERE j < k GROUP BY 1, 2), pk AS MATERIALIZED (SELECT hid, k, row_number() OVER (PARTITION BY hid ORDER BY k) - 1 AS peak FROM cl ANTI JOIN up USING (hid, k)),
sl(hid, k, p) AS (SELECT hid, k, k FROM pk UNION ALL SELECT up.hid, up.k, sl.p FROM sl JOIN up ON up.hid = sl.hid AND up.j = sl.k),
fl(hid, p, t, k) AS (SELECT pk.hid, pk.k, cl.k, pk.k FROM pk JOIN cl ON cl.hid = pk.hid AND cl.k > pk.k WHERE peak > 0 UNION SELECT fl.hid, fl.p, fl.t, nb.j FROM fl JOIN nb ON nb.hid = fl.hid AND nb.k = fl.k AND nb.j <= fl.t),
sd AS (SELECT hid, p, min(t) AS t FROM fl JOIN pk USING (hid, k) WHERE k < p GROUP BY 1, 2)
SELECT cl.hid, cl.ix, cl.iy, cl.iz, cl.density, CAST(pk.peak AS BIGINT) AS peak, s.density AS saddle FROM cl JOIN sl USING (hid, k) JOIN pk ON pk.hid = sl.hid AND pk.k = sl.p LEFT JOIN sd ON sd.hid = sl.hid AND sd.p = sl.p LEFT JOIN cl s ON s.hid = sd.hid AND s.k = sd.t""")
def h3_separate_contours(spark, sf):
    return subhalo.separate_contours(subhalo.halo_density(clumps(spark, sf), 64)[0])


#: Members with cores by the side of their halo's middle, a third of them outside of any.
CORES = f"c AS MATERIALIZED (SELECT k.*, CASE WHEN indx % 3 > 0 THEN hid*2 + CASE WHEN x > mx THEN 1 ELSE 0 END END AS core FROM ({CLUMPS}) k JOIN (SELECT hid, avg(x) AS mx FROM ({CLUMPS}) GROUP BY 1) USING (hid))"


def _cores(spark, sf):
    c = clumps(spark, sf)
    both = c.join(c.groupBy("hid").agg(F.avg("x").alias("mx")), "hid")
    return cut(both.withColumn("core", F.when(F.col("indx") % 3 > 0, F.col("hid") * 2 + (F.col("x") > F.col("mx")).cast("long"))).drop("mx"))


def _spread_sql(edge: int) -> str:
    """kn, hh, m with its own h in cells of the edge, and w(hid, indx, ix, iy, iz, w): each member's spline at the centres within 2h."""
    out = f"{KNN}, hh AS (SELECT hid, id AS indx, sqrt(max(r2))/2/{edge}e0 AS h FROM kn GROUP BY 1, 2), m AS MATERIALIZED (SELECT hid, indx, x/{edge}e0 AS qx, y/{edge}e0 AS qy, z/{edge}e0 AS qz, greatest(coalesce(h, 0.5e0), 0.5e0) AS h FROM c LEFT JOIN hh USING (hid, indx))"
    src = "m"
    for c in "xyz":
        out += f", e{c} AS (SELECT *, unnest(range(CAST(ceil(q{c}-2*h) AS BIGINT), CAST(floor(q{c}+2*h) AS BIGINT)+1)) AS i{c} FROM {src})"
        src = f"e{c}"
    return out + f", w AS (SELECT hid, indx, ix, iy, iz, {_W4.format(q='(r/h)')} AS w FROM (SELECT *, sqrt((ix-qx)*(ix-qx)+(iy-qy)*(iy-qy)+(iz-qz)*(iz-qz)) AS r FROM ez WHERE (ix-qx)*(ix-qx)+(iy-qy)*(iy-qy)+(iz-qz)*(iz-qz) < 4*h*h))"


#: A tenth of the members are far from the others, so their splines reach a tenth of the box: cells are wide.
_EDGE = 2048
_CL = f"{_spread_sql(_EDGE)}, cl AS MATERIALIZED (SELECT hid, ix, iy, iz, sum(w) AS density FROM w GROUP BY 1, 2, 3, 4)"


def _seventh(c: str):
    """Rounded to seven digits as SQL does, without the decimal text of each number that F.round makes, which took about half of the time."""
    return F.floor(F.col(c) * 1e7 + 0.5) / 1e7


@query(f"WITH {_CL} SELECT hid, ix, iy, iz, round(density, 7) AS density FROM cl")
def h1_spline_density(spark, sf):
    return subhalo.spline_density(clumps(spark, sf), _EDGE, 5, BOX)[0].withColumn("density", _seventh("density"))


@query(f"""WITH {_CL}, k AS (SELECT hid, indx, CAST(floor(qx) AS BIGINT) + a.o AS ix, CAST(floor(qy) AS BIGINT) + b.o AS iy, CAST(floor(qz) AS BIGINT) + e.o AS iz, abs(1-a.o-(qx-floor(qx)))*abs(1-b.o-(qy-floor(qy)))*abs(1-e.o-(qz-floor(qz))) AS v FROM m, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o), (VALUES (0), (1)) e(o))
SELECT k.hid, k.indx, round(sum(v*coalesce(density, 0)), 7) AS density FROM k LEFT JOIN cl USING (hid, ix, iy, iz) GROUP BY 1, 2""")
def h1_spline_members(spark, sf):
    """The density read back at the members' places."""
    return subhalo.spline_density(clumps(spark, sf), _EDGE, 5, BOX)[1].withColumn("density", _seventh("density"))


@query(f"WITH {_spread_sql(_EDGE)} SELECT ((ix % 8) + 8) % 8 AS ix, ((iy % 8) + 8) % 8 AS iy, ((iz % 8) + 8) % 8 AS iz, round(sum(w), 7) AS value FROM w GROUP BY 1, 2, 3")
def a13_deposit_adaptive(spark, sf):
    """All members on the periodic mesh, each with a smoothing length of its own."""
    c = clumps(spark, sf)
    h = knn_in_group(c, 5, BOX).groupBy("hid", F.col("id").alias("indx")).agg((F.sqrt(F.max("r2").cast("double")) / 2 / _EDGE).alias("h"))
    rows = c.join(cut(h), ["hid", "indx"], "left")
    return deposit_adaptive(rows, {v: F.col(v) / _EDGE for v in "xyz"}, F.col("h"), n=8).withColumn("value", F.round("value", 7))


@query(f"""WITH c AS ({CLUMPS}), cl AS MATERIALIZED (SELECT hid, ix, iy, iz, sum(w) AS density FROM (SELECT hid, x//64 + a.o AS ix, y//64 + b.o AS iy, z//64 + e.o AS iz, abs(1-a.o-(x%64)/64e0)*abs(1-b.o-(y%64)/64e0)*abs(1-e.o-(z%64)/64e0) AS w FROM c, (VALUES (0), (1)) a(o), (VALUES (0), (1)) b(o), (VALUES (0), (1)) e(o)) GROUP BY 1, 2, 3, 4),
pk AS (SELECT hid, ix, iy, iz, density FROM cl a WHERE density > 1.5 AND NOT EXISTS (SELECT 1 FROM cl b WHERE b.hid = a.hid AND b.ix BETWEEN a.ix-1 AND a.ix+1 AND b.iy BETWEEN a.iy-1 AND a.iy+1 AND b.iz BETWEEN a.iz-1 AND a.iz+1 AND (b.ix, b.iy, b.iz) <> (a.ix, a.iy, a.iz) AND b.density >= a.density))
SELECT * FROM pk WHERE 10 <= (SELECT count(*) FROM c WHERE c.hid = pk.hid AND abs(c.x//64 - ix) <= 1 AND abs(c.y//64 - iy) <= 1 AND abs(c.z//64 - iz) <= 1)""")
def h2_seeded_peaks(spark, sf):
    c = clumps(spark, sf)
    return subhalo.seeded_peaks(subhalo.density_peaks(subhalo.halo_density(c, 64)[0]), c, 64)


@query(f"SELECT hid, indx, true AS within FROM ({CLUMPS})")
def a6_tree_potential(spark, sf):
    """Far cells taken at their centres, for all halos of over ten members: whether each potential is within the bound about the exact one."""
    c = cut(clumps(spark, sf).select("hid", "indx", "x", "y", "z"))
    both = halo.pair_potential(c, exact=10).select("hid", "indx", "pe").join(halo.pair_potential(c).select("hid", "indx", F.col("pe").alias("want")), ["hid", "indx"])
    return both.select("hid", "indx", (F.abs(F.col("pe") - F.col("want")) <= 0.5 * F.abs("want") + 1e-9).alias("within"))


_STRENGTH = 1e6


def _unbind_sql(rounds: int = 4) -> str:
    out, d = [f"{CORES}, u0 AS MATERIALIZED (SELECT * FROM c WHERE core IS NOT NULL)"], ", ".join(f"avg({v}) AS m{v}" for v in _COLS)
    for k in range(rounds):
        ke = " + ".join(f"pow(u.v{v}-g.mv{v} + 0.7e0*(u.{v}-g.m{v}), 2)" for v in "xyz")
        r2 = "+".join(f"pow(a.{v}-b.{v}, 2)" for v in "xyz")
        out.append(f"""g{k} AS (SELECT core, {d} FROM u{k} GROUP BY 1), k{k} AS (SELECT u.core, u.indx, 0.5e0*({ke}) AS ke FROM u{k} u JOIN g{k} g USING (core)),
p{k} AS (SELECT a.core, a.indx, -sum(1/sqrt({r2}+0.01e0)) AS pe FROM u{k} a JOIN u{k} b ON a.core = b.core AND a.indx <> b.indx GROUP BY 1, 2),
u{k + 1} AS MATERIALIZED (SELECT u.* FROM u{k} u JOIN k{k} USING (core, indx) LEFT JOIN p{k} USING (core, indx) WHERE ke + {_STRENGTH!r}*coalesce(pe, 0) <= 0)""")
    return ", ".join(out) + f" SELECT core, indx FROM u{rounds}"


@query(f"WITH {_unbind_sql()}")
def h4_unbind(spark, sf):
    return subhalo.unbind(_cores(spark, sf).filter("core is not null"), 0.7, _STRENGTH).select("core", "indx")


_SHELL = "CAST(floor(4*log2(greatest({}, 1e-12))) AS INTEGER)"


def _bottom_up_sql(rounds: int = 4) -> str:
    """The odd core of a halo is inside of the even one: rounds for the odd, which lose to the even, then rounds for these."""
    square = lambda a, b: "+".join(f"({a}{v}-{b}{v})*({a}{v}-{b}{v})" for v in "xyz")
    mean = ", ".join(f"avg({v}) AS m{v}" for v in _COLS)
    out = [
        f"{CORES}, ce AS MATERIALIZED (SELECT core, {mean} FROM c WHERE core IS NOT NULL GROUP BY 1)",
        f"pc AS MATERIALIZED (SELECT core, {_SHELL.format(square('p.', 'e.m'))} AS j, count(*) AS n FROM c p JOIN ce e USING (core) WHERE core % 2 = 0 GROUP BY 1, 2)",
        f"dd AS (SELECT a.core, {_SHELL.format(square('a.m', 'b.m'))} AS j FROM ce a JOIN ce b ON b.core = a.core - 1 WHERE a.core % 2 = 1)",
        "bg AS MATERIALIZED (SELECT dd.core, sum(n) AS bg, dd.j AS bj FROM dd JOIN pc ON pc.core = dd.core - 1 AND pc.j <= dd.j GROUP BY dd.core, dd.j)",
        f"o0 AS MATERIALIZED (SELECT c.core, bg, bj, indx, {', '.join(_COLS)} FROM c LEFT JOIN bg USING (core) WHERE c.core % 2 = 1)",
    ]
    for part in "oe":
        if part == "e":
            out.append(f"e0 AS MATERIALIZED (SELECT core, CAST(NULL AS BIGINT) AS bg, CAST(NULL AS INTEGER) AS bj, indx, {', '.join(_COLS)} FROM c WHERE core % 2 = 0 UNION ALL SELECT core - 1, NULL, NULL, indx, {', '.join(_COLS)} FROM o0 ANTI JOIN o{rounds} USING (core, indx))")
        for k in range(rounds):
            u, n = f"{part}{k}", f"{part}{k}"
            ke = "+".join(f"(u.v{v}-g.mv{v} + 0.7e0*(u.{v}-g.m{v}))*(u.v{v}-g.mv{v} + 0.7e0*(u.{v}-g.m{v}))" for v in "xyz")
            out.append(f"""g{n} AS (SELECT core, {mean} FROM {u} GROUP BY 1), s{n} AS MATERIALIZED (SELECT u.*, {_SHELL.format(square('u.', 'g.m'))} AS j, 0.5e0*({ke}) AS ke FROM {u} u JOIN g{n} g USING (core)),
l{n} AS (SELECT core, max(j) AS lim FROM (SELECT core, j, bg, bj, sum(count(*)) OVER (PARTITION BY core ORDER BY j) AS n FROM s{n} WHERE bg IS NOT NULL GROUP BY core, j, bg, bj) WHERE n >= 3*bg*pow(2e0, 3*(j-bj)/8e0) GROUP BY 1),
w{n} AS MATERIALIZED (SELECT s.* FROM s{n} s LEFT JOIN l{n} l USING (core) WHERE bg IS NULL OR j <= lim),
p{n} AS (SELECT a.core, a.indx, -sum(1/sqrt({square('a.', 'b.')}+0.01e0)) AS pe FROM w{n} a JOIN w{n} b ON a.core = b.core AND a.indx <> b.indx GROUP BY 1, 2),
{part}{k + 1} AS MATERIALIZED (SELECT w.core, bg, bj, indx, {', '.join(_COLS)} FROM w{n} w LEFT JOIN p{n} USING (core, indx) WHERE ke + {_STRENGTH!r}*coalesce(pe, 0) <= 0)""")
    return ", ".join(out) + f" SELECT c.indx, coalesce(o.core, e.core) AS core FROM c LEFT JOIN o{rounds} o USING (indx) LEFT JOIN e{rounds} e USING (indx)"


@query(f"WITH {_bottom_up_sql()}")
def h4_unbind_bottom_up(spark, sf):
    """Inner cores first, within their tidal radius, and what they lose goes to the core around them."""
    rows = _cores(spark, sf)
    cores = rows.filter("core is not null").select("core").distinct()
    tree = cores.filter("core % 2 = 1").selectExpr("core", "core - 1 AS parent").unionByName(rows.filter("core is not null").selectExpr("core - core % 2 AS core", "cast(null AS bigint) AS parent").distinct())
    return subhalo.unbind_cores(rows, tree, 0.7, _STRENGTH).select("indx", "core")


_H5_NEAR = "pow(a.x-b.x, 2)+pow(a.y-b.y, 2)+pow(a.z-b.z, 2) <= 40000"


@query(f"""WITH RECURSIVE {CORES}, o AS (SELECT * FROM c WHERE core IS NULL), pr AS MATERIALIZED (SELECT a.indx AS i, b.indx AS j FROM o a JOIN o b ON a.hid = b.hid AND a.indx <> b.indx AND {_H5_NEAR}),
r(i, l) AS (SELECT indx, indx FROM o UNION SELECT pr.j, r.l FROM r JOIN pr ON pr.i = r.i), lab AS (SELECT i AS indx, min(l) AS root FROM r GROUP BY 1),
t AS (SELECT root, min(b.core) AS core FROM lab JOIN o a USING (indx) JOIN c b ON a.hid = b.hid AND b.core IS NOT NULL AND {_H5_NEAR} GROUP BY 1) SELECT indx, core FROM lab JOIN t USING (root)""")
def h5_assign_shell(spark, sf):
    rows = _cores(spark, sf)
    return subhalo.assign_shell(rows.filter("core is null"), rows.filter("core is not null"), 200)


@query(f"WITH {CORES} SELECT hid, core, CAST(count(*) AS BIGINT) AS np, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz FROM c GROUP BY 1, 2")
def h6_subhalo_catalog(spark, sf):
    """The catalogue, and a row for each halo's background, without a core."""
    found, background = subhalo.subhalo_catalog(_cores(spark, sf))
    rest = background.groupBy("hid", "core").agg(F.count("*").alias("np"), *(F.sum(c).alias(f"s{c}") for c in "xyz"))
    return found.select("hid", "core", "np", "sx", "sy", "sz").unionByName(rest.withColumn("core", F.col("core").cast("long")))
