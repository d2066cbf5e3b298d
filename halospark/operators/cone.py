"""Lightcones: observers, shells, replicated boxes, images."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fisheye_pixel, min_image_signed, rotate_disk, view_pixel
from .filters import shell_zone


def observer_lattice(spark: SparkSession, box: int, kind: str = "centres") -> DataFrame:
    """(iobs, ox, oy, oz): the 64 centres of 4^3 cells, or four points (a corner and three face centres) of each of 27 cells."""
    if kind == "centres":
        cells = spark.range(64).selectExpr("id AS iobs", "id div 16 AS i", "id div 4 % 4 AS j", "id % 4 AS k")
        return cells.select("iobs", *((F.col(c) * (box // 4) + box // 8).alias(o) for c, o in zip("ijk", ("ox", "oy", "oz"))))
    cells = spark.range(108).selectExpr("id AS iobs", "id div 36 AS i", "id div 12 % 3 AS j", "id div 4 % 3 AS k", "id % 4 AS p")
    half = lambda axis: F.when((F.col("p") != 0) & (F.col("p") != axis), 0.5).otherwise(0.0)
    return cells.select("iobs", *(((F.col(c) + half(a)) * (box / 3)).alias(o) for a, (c, o) in enumerate(zip("ijk", ("ox", "oy", "oz")), 1)))


def prune_observers(slabs: DataFrame, observers: DataFrame, reach: int, box: int) -> DataFrame:
    """(slab, iobs, ...) of the observers whose shell can reach a slab (slab, zmin, zmax), across the periodic face too."""
    below, above = F.col("zmin") - F.col("oz"), F.col("oz") - F.col("zmax")
    gap = F.greatest(F.lit(0), F.least(F.greatest(below, above), F.greatest(below + box, above - box), F.greatest(below - box, above + box)))
    return slabs.join(F.broadcast(observers), gap <= reach)


def seen_by(particles: DataFrame, observers: DataFrame, box: int, low: int, high: int, first: bool = True, key: str = "indx") -> DataFrame:
    """Particles with iobs, their position from the observer (dx, dy, dz; nearest image) and r2, where low^2 <= r2 < high^2.

    first: only the first observer, in the order of iobs, of each particle. observers: a fixed list, broadcast."""
    n = max(1, box // high)  # cells at least as wide as the reach; the last one may be wider
    cell = lambda c: F.least(F.floor(F.col(c) * n / box), F.lit(n - 1)).cast("long")
    around = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("abc", o))) for o in product((-1, 0, 1), repeat=3)))
    near = observers.withColumn("_o", F.explode(around)).withColumns({f"_{c}": F.pmod(cell(f"o{c}") + F.col(f"_o.{k}"), F.lit(n)) for c, k in zip("xyz", "abc")}).drop("_o").distinct()
    d = lambda c, o: min_image_signed(F.col(c) - o, box)
    if first:  # a row is looked at with all observers of its cell, so rows are not multiplied and their first observer is known where they are
        near = near.groupBy("_x", "_y", "_z").agg(F.sort_array(F.collect_list(F.struct("iobs", "ox", "oy", "oz"))).alias("_obs"))
        rows = particles.withColumns({f"_{c}": cell(c) for c in "xyz"}).join(F.broadcast(near), ["_x", "_y", "_z"]).drop("_x", "_y", "_z")
        from_there = lambda o: [d(c, o[f"o{c}"]) for c in "xyz"]
        square = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
        seen = F.filter("_obs", lambda o: (square(from_there(o)) >= low * low) & (square(from_there(o)) < high * high))
        rows = rows.withColumn("_o", F.get(seen, F.lit(0))).drop("_obs").filter("_o is not null")
        rows = rows.withColumn("iobs", F.col("_o.iobs")).withColumns({f"d{c}": d(c, F.col(f"_o.o{c}")) for c in "xyz"}).drop("_o")
        rows = rows.withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
        return rows.select(key, "iobs", *(c for c in rows.columns if c not in (key, "iobs")))
    rows = particles.withColumns({f"_{c}": cell(c) for c in "xyz"}).join(F.broadcast(near), ["_x", "_y", "_z"]).drop("_x", "_y", "_z")
    rows = rows.withColumns({f"d{c}": d(c, F.col(f"o{c}")) for c in "xyz"}).withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return rows.filter((F.col("r2") >= low * low) & (F.col("r2") < high * high)).drop("ox", "oy", "oz")


def spherical_cone(particles: DataFrame, observers: DataFrame, box: int, r1: int, r2: int, maxd: int) -> DataFrame:
    """Particles in the shell of their first observer, with the zone (main, outer, inner), sorted within tasks by observer and zone."""
    seen = seen_by(particles, observers, box, max(0, r1 - maxd), r2 + maxd)
    return sort_cone(seen.withColumn("type", shell_zone(F.col("r2"), r1, r2, maxd)))


def sort_cone(cone: DataFrame) -> DataFrame:
    """O2: a cone's rows by observer, type and particle, in ranges."""
    order = ("iobs", "type", "indx")
    return cone.repartitionByRange(*order).sortWithinPartitions(*order)


def replicate_box(df: DataFrame, box: int, images: list[tuple[int, int, int]]) -> DataFrame:
    """Every row at each of a fixed list of periodic images, numbered from 0."""
    moved = F.array(*(F.struct(F.lit(k).alias("image"), *(F.lit(s * box).alias(c) for s, c in zip(o, "xyz"))) for k, o in enumerate(images)))
    return df.withColumn("_i", F.explode(moved)).withColumns({c: F.col(c) + F.col(f"_i.{c}") for c in "xyz"}).withColumn("image", F.col("_i.image")).drop("_i")


def disk_cone(particles: DataFrame, box: int, images: list[tuple[int, int, int]], r1: float, r2: float, half: float) -> DataFrame:
    """All images of particles in the shell [r1, r2) about the origin and in the tilted disk of the given half thickness."""
    rows = replicate_box(particles, box, images)
    rows = rows.withColumn("r2", F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).filter((F.col("r2") >= r1 * r1) & (F.col("r2") < r2 * r2))
    rx, ry, rz = rotate_disk(F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double"))
    return rows.withColumns({"rx": rx, "ry": ry, "rz": rz}).filter((F.col("rz") >= -half) & (F.col("rz") < half))


def grid_cone(grid: DataFrame, observers: DataFrame, n: int, r1: int, r2: int, maxd: int) -> DataFrame:
    """Cells of a sparse grid in the shell of their first observer, with index, zone and value. Positions are cell numbers."""
    cells = grid.select(((F.col("iz") * n + F.col("iy")) * n + F.col("ix")).alias("index"), F.col("ix").alias("x"), F.col("iy").alias("y"), F.col("iz").alias("z"), "value")
    seen = seen_by(cells, observers, n, max(0, r1 - maxd), r2 + maxd, key="index")
    return seen.select("index", "iobs", shell_zone(F.col("r2"), r1, r2, maxd).alias("type"), "value")


def sync_velocity(half_prev: DataFrame, half_next: DataFrame, gv1: float, gv2: float, vf1: float, key: str = "indx") -> DataFrame:
    """Velocities at a step from those of the half steps around it: gv1 v0 + gv2 (v1 - vf1 v0)."""
    both = half_prev.alias("a").join(half_next.alias("b"), key)
    return both.select(key, *((gv1 * F.col(f"a.{c}") + gv2 * (F.col(f"b.{c}") - vf1 * F.col(f"a.{c}"))).alias(c) for c in ("vx", "vy", "vz")))


def sync_coefficients(a: float, astep: float, app: float, apsq: float, n: float) -> tuple[float, float, float]:
    """(gv1, gv2, vf1) of a leapfrog step of the scale factor."""
    af, bf = (2 + app * a / apsq) / (2 * a), 1 / (a**3 * apsq)
    v1, v2 = (1 - af * astep) / (1 + af * astep), bf * astep / (1 + af * astep) * n
    v1h, v2h = 1 - af * astep, bf * astep * 0.5 * n
    return v1 / v1h, (v2 - v1 * v2h) / v2, v1


def observer_image(particles: DataFrame, camera: DataFrame, size: int) -> DataFrame:
    """(frame, mx, my, light): the sum of exp(-r/tau)/r^2 in each pixel of each frame of a fixed camera list (frame, cx, cy, cz, tau), looking along z."""
    rows = particles.join(F.broadcast(camera), F.col("z") > F.col("cz"))
    d = [F.col(c) - F.col(f"c{c}") for c in "xyz"]
    rows = rows.withColumn("r", F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).cast("double"))).filter((F.col("r") > 0) & (F.col("r") <= 5 * F.col("tau")))
    angle, mx, my = fisheye_pixel(*(x.cast("double") for x in d), size)
    light = F.exp(-F.col("r") / F.col("tau")) / (F.col("r") * F.col("r"))
    return rows.select("frame", angle.alias("angle"), mx.alias("mx"), my.alias("my"), light.alias("light")).filter(F.col("angle") < math.pi / 2).groupBy("frame", "mx", "my").agg(F.sum("light").alias("light"))


def observer_images(particles: DataFrame, camera: DataFrame, size: int, box: int, images: list[tuple[int, int, int]], cells: int = 16) -> DataFrame:
    """(frame, mx, my, light) of a camera list (frame, cx, cy, cz, tau, ahead, right, up; unit vectors as arrays) that sees the periodic images of
    the box: the sum of exp(-r/tau)/r^2 of what is in front and nearer than five tau, by pixel.

    Each frame lists the cells of each image that its sphere of five tau touches and that are not all behind it, and particles meet the
    frames of their cell only."""
    wide = box / cells
    seen = camera.withColumn("_i", F.explode(F.array(*(F.struct(*(F.lit(float(v * box)).alias(c) for c, v in zip("xyz", o))) for o in images))))
    seen = seen.withColumns({f"o{c}": F.col(f"c{c}") + F.col(f"_i.{c}") for c in "xyz"}).drop("_i", "cx", "cy", "cz").withColumns({"_near": F.lit(0.0), "_front": F.lit(0.0)})
    for k, c in enumerate("xyz"):
        seen = seen.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        low, high = F.col(f"_{c}") * wide - F.col(f"o{c}"), (F.col(f"_{c}") + 1) * wide - F.col(f"o{c}")
        gap = F.greatest(low, -high, F.lit(0.0))
        seen = seen.withColumns({"_near": F.col("_near") + gap * gap, "_front": F.col("_front") + F.greatest(low * F.col("ahead")[k], high * F.col("ahead")[k])}).filter(F.col("_near") <= 25 * F.col("tau") * F.col("tau"))
    seen = seen.filter(F.col("_front") >= 0).drop("_near", "_front").withColumns({f"_{c}": F.col(f"_{c}").cast("long") for c in "xyz"})
    cell = lambda c: F.least(F.floor(F.col(c) / wide), F.lit(cells - 1)).cast("long")
    rows = particles.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), *(cell(c).alias(f"_{c}") for c in "xyz")).join(seen, ["_x", "_y", "_z"])
    d = [F.col(c) - F.col(f"o{c}") for c in "xyz"]
    rows = rows.withColumn("r", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).filter((F.col("r") > 0) & (F.col("r") <= 5 * F.col("tau")))
    angle, mx, my = view_pixel(d, *([F.col(v)[k] for k in range(3)] for v in ("ahead", "right", "up")), size)
    light = F.exp(-F.col("r") / F.col("tau")) / (F.col("r") * F.col("r"))
    rows = rows.select("frame", angle.alias("angle"), mx.alias("mx"), my.alias("my"), light.alias("light")).filter((F.col("angle") <= math.pi / 2) & F.col("mx").between(0, size - 1) & F.col("my").between(0, size - 1))
    return rows.groupBy("frame", "mx", "my").agg(F.sum("light").alias("light"))


def write_cone(cone: DataFrame, path: str) -> None:
    """A folder for each observer, zone and step."""
    cone.write.partitionBy("iobs", "type", "step").parquet(path)


def comoving_distance(steps: DataFrame, om: float, ol: float, amax: float, parts: int = 64) -> DataFrame:
    """Steps (step, a) with r, c/H0 times the integral of dz/E from 0 to the step's redshift, by `parts` trapezoids."""
    from ..functions.scalars import hubble_e

    z = F.col("z") * F.col("k") / parts
    points = steps.withColumn("z", amax / F.col("a") - 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts))))
    weight = F.when((F.col("k") == 0) | (F.col("k") == parts), 0.5).otherwise(1.0)
    return points.groupBy("step").agg((2997.92458 * F.sum(weight * F.col("z") / parts / hubble_e(1 / (1 + z), om, ol))).alias("r"))


def box_extent(df: DataFrame, by: Column) -> DataFrame:
    """V9: least and greatest z of each slab."""
    return df.groupBy(by.alias("slab")).agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"))
