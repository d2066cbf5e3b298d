"""Queries for the column functions and filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters
from ..operators.cone import observer_lattice, replicate_box, sync_velocity
from ..operators.fof import prefof_filter
from ..operators.halo import kinetic
from ..operators.massfunc import drop_group_head, h_rescale
from .base import CENTRED, LABELS, TREE, query
from .fixtures import AMAX, BOX, CLUMPS, HALO_PROPS, LINK, PARTICLES, RUN_STEPS, clumps, halo_props, particles, run_steps

OM, OL, W0, WA = 0.26, 0.74, -0.9, 0.1
_A = f"(a/{AMAX}e0)"
_SCALE = f"(pow({_A}, {-3 * (1 + W0 + WA)!r}e0) * exp({-3 * WA!r}e0 * (1 - {_A})))".replace("e0e0", "e0")
_E2 = f"({OM}e0/({_A}*{_A}*{_A}) + {1 - OM - OL!r}e0/({_A}*{_A}) + {OL}e0*{_SCALE})".replace("e-17e0", "e-17")


@query(f"SELECT indx, ((vx + indx%64)%64 + 64)%64 AS x, ((vy + (indx%4096)//64)%64 + 64)%64 AS y, ((vz + indx//4096)%64 + 64)%64 AS z FROM ({PARTICLES})")
def p1_decode_position(spark, sf):
    x, y, z = S.decode_position(F.col("vx"), F.col("vy"), F.col("vz"), F.col("indx"), 64, 4096, 64)
    return particles(spark, sf).select("indx", x.alias("x"), y.alias("y"), z.alias("z"))


@query(f"SELECT indx, ((z//256)*64 + y//256)*64 + x//256 AS cell FROM ({PARTICLES})")
def p2_lattice_index(spark, sf):
    return particles(spark, sf).select("indx", S.lattice_index(F.expr("x div 256"), F.expr("y div 256"), F.expr("z div 256"), 64, 64).alias("cell"))


@query(f"SELECT indx, least(abs(x-y), {BOX}-abs(x-y)) AS d, CASE WHEN (x-y)*2 > {BOX} THEN x-y-{BOX} WHEN (x-y)*2 < -{BOX} THEN x-y+{BOX} ELSE x-y END AS signed FROM ({PARTICLES})")
def p3_min_image(spark, sf):
    d = F.col("x") - F.col("y")
    return particles(spark, sf).select("indx", S.min_image(d, BOX).alias("d"), S.min_image_signed(d, BOX).alias("signed"))


@query(f"SELECT indx, round(x*{1024 / BOX!r}e0, 6) AS r, round(vx*{1024 / 48!r}e0*0.5e0*0.5e0*100e0*1.5e0, 6) AS v FROM ({PARTICLES})")
def p4_to_physical(spark, sf):
    v = S.velocity_to_physical(F.col("vx"), 1024.0, 48.0, F.lit(0.5), F.lit(1.5))
    return particles(spark, sf).select("indx", F.round(S.to_physical(F.col("x"), 1024.0, BOX), 6).alias("r"), F.round(v, 6).alias("v"))


@query(f"SELECT step, round(sqrt({_E2}), 6) AS e FROM ({RUN_STEPS})")
def p5_hubble_e(spark, sf):
    return run_steps(spark, sf).select("step", F.round(S.hubble_e(F.col("a") / AMAX, OM, OL, W0, WA), 6).alias("e"))


@query(f"SELECT step, round({W0}e0 + {WA}e0*({AMAX}e0/a - 1)/({AMAX}e0/a), 6) AS w, round({OM}e0/({_A}*{_A}*{_A})/{_E2}, 6) AS om, round({OL}e0*{_SCALE}/{_E2}, 6) AS ode FROM ({RUN_STEPS})")
def p6_equation_of_state(spark, sf):
    a, z = F.col("a") / AMAX, AMAX / F.col("a") - 1
    return run_steps(spark, sf).select("step", F.round(S.w_de(z, W0, WA), 6).alias("w"), F.round(S.omega_m(a, OM, OL, W0, WA), 6).alias("om"), F.round(S.omega_de(a, OM, OL, W0, WA), 6).alias("ode"))


@query(f"SELECT step, round({AMAX}e0/a - 1, 9) AS z, round({AMAX}e0/(1 + 0.25e0*(step-1)) - 1, 9) AS z_of_step FROM ({RUN_STEPS})")
def p7_redshift(spark, sf):
    return run_steps(spark, sf).select("step", F.round(S.redshift(F.col("a"), float(AMAX)), 9).alias("z"), F.round(S.redshift_of_step(F.col("step"), float(AMAX), 0.25), 9).alias("z_of_step"))


@query(f"SELECT hid, round(count(*)*{S.particle_mass(OM, 1024.0, BOX, 8)!r}e0, 0) AS mass FROM ({CLUMPS}) GROUP BY 1")
def p8_halo_mass(spark, sf):
    return clumps(spark, sf).groupBy("hid").agg(F.round(F.count("*") * S.particle_mass(OM, 1024.0, BOX, 8), 0).alias("mass"))


@query(f"SELECT indx, CAST(indx%16 AS INTEGER) | 4 AS set4, CAST(indx%16 AS INTEGER) & -5 AS unset4, xor(CAST(indx%16 AS INTEGER), 4) AS toggle4, (CAST(indx%16 AS INTEGER) & 4) <> 0 AS is4 FROM ({PARTICLES})")
def p9_flags(spark, sf):
    f = (F.col("indx") % 16).cast("int")
    return particles(spark, sf).select("indx", S.set_flag(f, 4).alias("set4"), S.unset_flag(f, 4).alias("unset4"), S.toggle_flag(f, 4).alias("toggle4"), S.is_flag(f, 4).alias("is4"))


@query(f"SELECT indx, CASE WHEN indx & 2 <> 0 THEN 'A' WHEN indx & 1 <> 0 THEN 'N' WHEN indx & 4 <> 0 THEN 'J' WHEN indx & 8 <> 0 THEN 'I' ELSE 'U' END AS code FROM ({PARTICLES})".replace("indx & 2 <>", "(indx & 2) <>").replace("indx & 1 <>", "(indx & 1) <>").replace("indx & 4 <>", "(indx & 4) <>").replace("indx & 8 <>", "(indx & 8) <>"))
def p10_status_code(spark, sf):
    return particles(spark, sf).select("indx", S.status_code(F.col("indx").cast("int")).alias("code"))


@query(f"""SELECT indx, round(CASE WHEN q < 1 THEN 1 - 1.5e0*q*q + 0.75e0*q*q*q WHEN q < 2 THEN 0.25e0*(2-q)*(2-q)*(2-q) ELSE 0 END / (pi()*8e0), 9) AS w FROM (SELECT indx, (x % 1000)/250e0/2e0 AS q FROM ({PARTICLES}))""")
def p11_w4_kernel(spark, sf):
    return particles(spark, sf).select("indx", F.round(S.w4_kernel((F.col("x") % 1000) / 250.0, F.lit(2.0)), 9).alias("w"))


_C = {"cx": math.cos(S.DISK_X), "sx": math.sin(S.DISK_X), "cy": math.cos(S.DISK_Y), "sy": math.sin(S.DISK_Y)}
ROTATED = "x*{cy!r}e0 + (y*{sx!r}e0 + z*{cx!r}e0)*{sy!r}e0 AS rx, y*{cx!r}e0 - z*{sx!r}e0 AS ry, (y*{sx!r}e0 + z*{cx!r}e0)*{cy!r}e0 - x*{sy!r}e0 AS rz".format(**_C)


@query(f"SELECT indx, round(rx, 6) AS rx, round(ry, 6) AS ry, round(rz, 6) AS rz FROM (SELECT indx, {ROTATED} FROM ({PARTICLES}))")
def p12_rotate_disk(spark, sf):
    return particles(spark, sf).select("indx", *(F.round(c, 6).alias(f"r{n}") for c, n in zip(S.rotate_disk(*(F.col(c).cast("double") for c in "xyz")), "xyz")))


@query(f"SELECT indx, {', '.join(f'round(0.9e0*{v} + 0.6e0*({v} + indx%7 - 0.8e0*{v}), 6) AS {v}' for v in ('vx', 'vy', 'vz'))} FROM ({PARTICLES})")
def p13_sync_velocity(spark, sf):
    p = particles(spark, sf)
    after = p.select("indx", *((F.col(v) + F.col("indx") % 7).alias(v) for v in ("vx", "vy", "vz")))
    out = sync_velocity(p.select("indx", "vx", "vy", "vz"), after, 0.9, 0.6, 0.8)
    return out.select("indx", *(F.round(v, 6).alias(v) for v in ("vx", "vy", "vz")))


@query(f"WITH {CENTRED} SELECT hid, indx, round(0.5e0*({' + '.join(f'(dv{c} + 0.7e0*d{c})*(dv{c} + 0.7e0*d{c})' for c in 'xyz')}), 3) AS ke FROM d")
def p14_kinetic_energy(spark, sf):
    return kinetic(clumps(spark, sf), 0.7).select("hid", "indx", F.round("ke", 3).alias("ke"))


@query("SELECT round(mass/0.7e0, 3) AS mass, round(n*(0.7e0*0.7e0*0.7e0), 6) AS value, round((n+1)*(0.7e0*0.7e0*0.7e0), 6) AS hi, round((n-1)*(0.7e0*0.7e0*0.7e0), 6) AS lo, round(2*n*(0.7e0*0.7e0*0.7e0), 6) AS cumulative FROM (SELECT p_size*1e0 AS mass, count(*)*1e0 AS n FROM part GROUP BY 1)")
def p15_h_rescale(spark, sf):
    t = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_size").cast("double").alias("mass")).agg(F.count("*").cast("double").alias("value"))
    out = h_rescale(t.select("mass", "value", (F.col("value") + 1).alias("hi"), (F.col("value") - 1).alias("lo"), (F.col("value") * 2).alias("cumulative")), 0.7)
    return out.select(F.round("mass", 3).alias("mass"), *(F.round(c, 6).alias(c) for c in ("value", "hi", "lo", "cumulative")))


PIXEL = "acos(dz/r) AS angle, CAST(floor(32 + acos(dz/r)/{h!r}e0*32e0*cos(atan2(dy, dx))) AS BIGINT) AS mx, CAST(floor(32 + acos(dz/r)/{h!r}e0*32e0*sin(atan2(dy, dx))) AS BIGINT) AS my".format(h=math.pi / 2)


@query(f"SELECT indx, round(angle, 6) AS angle, mx, my FROM (SELECT indx, {PIXEL} FROM (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS r FROM (SELECT indx, x-8000.5e0 AS dx, y-8000.5e0 AS dy, z-8000.5e0 AS dz FROM ({PARTICLES})))) WHERE angle < {math.pi / 2!r}")
def p16_project_pixel(spark, sf):
    angle, mx, my = S.fisheye_pixel(*(F.col(c) - 8000.5 for c in "xyz"), 64)
    return particles(spark, sf).select("indx", angle.alias("angle"), mx.alias("mx"), my.alias("my")).filter(F.col("angle") < math.pi / 2).withColumn("angle", F.round("angle", 6))


@query(f"SELECT hid, round(sqrt(q*s), 9) AS sph, round(sqrt(q*s) - (-0.07e0*(log10(mass) - 12) + 0.68e0), 9) AS residual FROM ({HALO_PROPS}) WHERE mass > 0")
def p17_sphericity(spark, sf):
    sph = S.sphericity(F.col("q"), F.col("s"))
    return halo_props(spark, sf).filter("mass > 0").select("hid", F.round(sph, 9).alias("sph"), F.round(S.sphericity_residual(sph, F.col("mass")), 9).alias("residual"))


IMAGES = [(0, 0, 0), (-1, 0, 0), (0, -1, 0), (-1, -1, 0)]
IMAGES_SQL = f"(VALUES {', '.join(f'({k}, {o[0] * BOX}, {o[1] * BOX}, {o[2] * BOX})' for k, o in enumerate(IMAGES))}) t(image, sx, sy, sz)"


@query(f"SELECT indx, image, x+sx AS x, y+sy AS y, z+sz AS z FROM ({PARTICLES}), {IMAGES_SQL}")
def p18_replicate_box(spark, sf):
    return replicate_box(particles(spark, sf), BOX, IMAGES).select("indx", "image", "x", "y", "z")


@query(f"""WITH o AS (SELECT (i*4+j)*4+k AS iobs, i*{BOX // 4}+{BOX // 8} AS ox, j*{BOX // 4}+{BOX // 8} AS oy, k*{BOX // 4}+{BOX // 8} AS oz FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j), (SELECT unnest(range(4)) AS k))
SELECT iobs, CAST(count(*) AS BIGINT) AS n FROM ({PARTICLES}) p JOIN o ON abs(x-ox) <= {BOX // 8} AND abs(y-oy) <= {BOX // 8} AND abs(z-oz) <= {BOX // 8} GROUP BY 1""")
def p19_observer_lattice(spark, sf):
    o = observer_lattice(spark, BOX)
    inside = F.expr(" and ".join(f"abs({c}-o{c}) <= {BOX // 8}" for c in "xyz"))
    return particles(spark, sf).join(F.broadcast(o), inside).groupBy("iobs").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM ({PARTICLES}) WHERE z >= 4096 AND z < 6144")
def f1_slab_filter(spark, sf):
    return filters.slab_filter(particles(spark, sf), 4096, 6144)


@query(f"SELECT step, a FROM ({RUN_STEPS}) WHERE {AMAX}e0/a - 1 <= 4")
def f2_redshift_cut(spark, sf):
    return filters.redshift_cut(run_steps(spark, sf), AMAX / F.col("a") - 1, 4.0)


ZONE = "CASE WHEN r2 >= 1000000 AND r2 < 3240000 THEN 'main' WHEN r2 >= 3240000 AND r2 < 3385600 THEN 'outer' WHEN r2 >= 921600 AND r2 < 1000000 THEN 'inner' END"


@query(f"SELECT indx, {ZONE} AS zone FROM (SELECT indx, pow(x-8192, 2)+pow(y-8192, 2)+pow(z-8192, 2) AS r2 FROM ({PARTICLES})) WHERE r2 >= 921600 AND r2 < 3385600")
def f3_shell_filter(spark, sf):
    r2 = sum((F.col(c) - 8192) * (F.col(c) - 8192) for c in "xyz")
    return particles(spark, sf).select("indx", filters.shell_zone(r2, 1000, 1800, 40).alias("zone")).filter("zone is not null")


@query(f"SELECT hid, CAST(count(*) AS BIGINT) AS np FROM ({CLUMPS}) GROUP BY 1 HAVING count(*) >= 20")
def f5_min_members(spark, sf):
    return filters.min_members(clumps(spark, sf), "hid", 20)


@query(f"SELECT hid, mass FROM ({HALO_PROPS}) WHERE mass >= 3000 AND mass < 8000")
def f6_mass_range(spark, sf):
    return filters.mass_range(halo_props(spark, sf), 3000, 8000).select("hid", "mass")


@query(f"SELECT indx FROM (SELECT indx, z-4000 AS dz, sqrt(pow(x-8000, 2)+pow(y-8000, 2)+pow(z-4000, 2)) AS r FROM ({PARTICLES})) WHERE dz > 0 AND r <= 4000")
def f7_optical_depth_cut(spark, sf):
    r = F.sqrt(sum((F.col(c) - o) * (F.col(c) - o) for c, o in zip("xyz", (8000, 8000, 4000))).cast("double"))
    return filters.optical_depth_cut(particles(spark, sf), r, F.col("z") - 4000, 800.0).select("indx")


@query(f"WITH {TREE} SELECT DISTINCT gid FROM tree WHERE step >= 1")
def f8_drop_empty_histories(spark, sf):
    from .tree_queries import tree

    t = tree(spark, sf)
    lines = t.withColumn("mbp", F.when(F.col("step") >= 1, F.col("mbp")))  # lines that are known at step 0 only are empty
    return filters.drop_empty_histories(lines).select("gid").distinct()


@query(f"WITH {TREE} SELECT step, gid, mass FROM tree WHERE gid = majorgid")
def f9_major_only(spark, sf):
    from .tree_queries import tree

    return filters.major_only(tree(spark, sf)).select("step", "gid", "mass")


@query(f"SELECT host, hid, mass FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY mass DESC, hid) AS rn FROM ({HALO_PROPS})) WHERE rn > 1")
def f10_drop_group_head(spark, sf):
    return drop_group_head(halo_props(spark, sf), "host", [-F.col("mass"), F.col("hid")]).select("host", "hid", "mass")


@query(f"WITH RECURSIVE {LABELS} SELECT label, np FROM big")
def f11_prefof_filter(spark, sf):
    from ..operators.fof import fof_groups

    kept = prefof_filter(particles(spark, sf), LINK, BOX, 2048)
    return filters.min_members(fof_groups(kept, LINK, BOX), "label", 20)
