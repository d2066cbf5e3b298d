"""Mesh deposits: particles to sparse grids, and operations on grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import w4_kernel


#: By scheme: the base cell of a position in cells, the cells around it that get a share, and the shares for the position off the base.
_SCHEMES = {
    "ngp": (F.floor, (0,), lambda f: [F.lit(1.0)]),
    "cic": (F.floor, (0, 1), lambda f: [1 - f, f]),
    "tsc": (lambda q: F.floor(q + F.lit(0.5)), (-1, 0, 1), lambda f: [F.lit(0.5) * (F.lit(0.25) + f * f - f), F.lit(0.75) - f * f, F.lit(0.5) * (F.lit(0.25) + f * f + f)]),
}


def deposit(particles: DataFrame, n: int, q: dict[str, Column], scheme: str = "tsc", value: Column | None = None) -> DataFrame:
    """(ix, iy, iz, value) of the cells of an n^3 periodic mesh that particles give to. q: positions in cells.

    scheme: cic (8 cells), tsc (27 cells) or ngp (1 cell). value: what each particle gives, 1 by default. The particles of a cell
    are summed first, one sum for each cell that they give to, and only these sums are dealt to the cells around."""
    base, offsets, weights = _SCHEMES[scheme]
    rows = particles.select(*(base(q[c]).alias(f"b{c}") for c in "xyz"), *(q[c].alias(f"q{c}") for c in "xyz"), (F.lit(1.0) if value is None else value.cast("double")).alias("v"))
    rows = rows.select("v", *(F.pmod(f"b{c}", F.lit(n)).cast("int").alias(f"b{c}") for c in "xyz"), *(w.alias(f"w{c}{k}") for c in "xyz" for k, w in enumerate(weights(F.col(f"q{c}") - F.col(f"b{c}")))))
    places = [(i, j, k) for i in range(len(offsets)) for j in range(len(offsets)) for k in range(len(offsets))]
    plane = {(i, j): F.col(f"wx{i}") * F.col(f"wy{j}") * F.col("v") for i, j, _ in places}
    sums = rows.groupBy("bx", "by", "bz").agg(*(F.sum(plane[i, j] * F.col(f"wz{k}")).alias(f"s{m}") for m, (i, j, k) in enumerate(places)))
    at = lambda c, d: F.pmod(F.col(f"b{c}") + d, F.lit(n)).cast("long")
    around = F.array(*(F.struct(at("x", offsets[i]).alias("ix"), at("y", offsets[j]).alias("iy"), at("z", offsets[k]).alias("iz"), F.col(f"s{m}").alias("w")) for m, (i, j, k) in enumerate(places)))
    return sums.select(F.explode(around).alias("e")).select("e.*").groupBy("ix", "iy", "iz").agg(F.sum("w").alias("value"))


def overdensity(grid: DataFrame, n: int, total: float) -> DataFrame:
    """Value over its mean, minus 1. Cells that aren't in the sparse grid are at -1."""
    return grid.withColumn("value", F.col("value") * (n**3 / total) - 1)


def dense(grid: DataFrame, n: int, fill: float = 0.0) -> DataFrame:
    """All n^3 cells; those not in the sparse grid get `fill`."""
    cells = grid.sparkSession.range(n**3).select((F.col("id") % n).alias("ix"), F.expr(f"(id div {n}) % {n}").alias("iy"), F.expr(f"id div {n * n}").alias("iz"))
    return cells.join(grid, ["ix", "iy", "iz"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def mean_velocity(density: DataFrame, momentum: DataFrame) -> DataFrame:
    """Momentum over density, 0 where the density isn't positive."""
    m = momentum.withColumnRenamed("value", "m")
    return density.join(m, ["ix", "iy", "iz"], "left").select("ix", "iy", "iz", F.when(F.col("value") > 0, F.coalesce("m", F.lit(0.0)) / F.col("value")).otherwise(0.0).alias("value"))


def bin_grid(grid: DataFrame, n: int) -> DataFrame:
    """Means over blocks of n^3 cells."""
    return grid.groupBy(*(F.expr(f"{c} div {n}").alias(c) for c in ("ix", "iy", "iz"))).agg((F.sum("value") / n**3).alias("value"))


def xz_slice(grid: DataFrame, rows=(0, 1, 2)) -> DataFrame:
    """(ix, iz, value) summed over the given iy."""
    return grid.filter(F.col("iy").isin(*rows)).groupBy("ix", "iz").agg(F.sum("value").alias("value"))


def xy_slice(grid: DataFrame, planes=(0, 1, 2)) -> DataFrame:
    """(ix, iy, value) summed over the given iz."""
    return grid.filter(F.col("iz").isin(*planes)).groupBy("ix", "iy").agg(F.sum("value").alias("value"))


def deposit_w4(points: DataFrame, n: int, reach: int, q: dict[str, Column], h: Column) -> DataFrame:
    """Each point's spline of radius 2h given to the cell centres within it (not periodic). reach: cells to look at on each side, at least 2h."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    rows = points.select(*(q[c].alias(f"q{c}") for c in "xyz"), h.alias("h"))
    for c in "xyz":
        rows = rows.withColumn(f"o{c}", F.explode(span)).withColumn(f"i{c}", (F.floor(f"q{c}") + F.col(f"o{c}")).cast("long"))
        rows = rows.filter(F.col(f"i{c}").between(0, n - 1) & (F.abs(F.col(f"i{c}") - F.col(f"q{c}")) < 2 * F.col("h")))
    r = F.sqrt(sum((F.col(f"i{c}") - F.col(f"q{c}")) * (F.col(f"i{c}") - F.col(f"q{c}")) for c in "xyz"))
    return rows.withColumn("w", w4_kernel(r, F.col("h"))).filter("w > 0").groupBy("ix", "iy", "iz").agg(F.sum("w").alias("value"))


def deposit_adaptive(points: DataFrame, q: dict[str, Column], h: Column, weight: Column | None = None, n: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, ix, iy, iz, value): each point's spline of its own radius 2h given to the cell centres within it.

    A point reaches exactly as many cells as its h asks for. n: cells along a periodic mesh, else the mesh has no end. q and h are in
    cells; a null h, or one under half a cell, which might reach no centre, counts as half a cell."""
    wide = F.greatest(F.coalesce(h, F.lit(0.5)), F.lit(0.5))
    rows = points.select(*keys, *(q[c].cast("double").alias(f"q{c}") for c in "xyz"), wide.alias("h"), (F.lit(1.0) if weight is None else weight).alias("m"), F.lit(0.0).alias("r2"))
    for c in "xyz":  # axis after axis, so that only cells in the sphere go on
        rows = rows.withColumn(f"i{c}", F.explode(F.sequence(F.ceil(F.col(f"q{c}") - 2 * F.col("h")), F.floor(F.col(f"q{c}") + 2 * F.col("h")))))
        d = F.col(f"i{c}") - F.col(f"q{c}")
        rows = rows.withColumn("r2", F.col("r2") + d * d).filter(F.col("r2") < 4 * F.col("h") * F.col("h"))
    at = [(F.pmod(f"i{c}", F.lit(n)) if n else F.col(f"i{c}")).cast("long").alias(f"i{c}") for c in "xyz"]
    return rows.select(*keys, *at, (F.col("m") * w4_kernel(F.sqrt("r2"), F.col("h"))).alias("w")).groupBy(*keys, "ix", "iy", "iz").agg(F.sum("w").alias("value"))


def gather(points: DataFrame, cells: DataFrame, q: dict[str, Column], value: str, keys: tuple[str, ...], key: str = "indx") -> DataFrame:
    """H1: (*keys, key, value): the cells' values at the points' places, linear between the eight centres around; missing cells are 0."""
    rows = points.select(*keys, key, *(q[c].cast("double").alias(f"q{c}") for c in "xyz"), F.lit(1.0).alias("w"))
    for c in "xyz":
        f = F.col(f"q{c}") - F.floor(f"q{c}")
        rows = rows.withColumn("_s", F.explode(F.array(F.struct(F.lit(0).alias("o"), (1 - f).alias("w")), F.struct(F.lit(1).alias("o"), f.alias("w")))))
        rows = rows.withColumn(f"i{c}", (F.floor(f"q{c}") + F.col("_s.o")).cast("long")).withColumn("w", F.col("w") * F.col("_s.w")).drop("_s")
    met = rows.join(cells, [*keys, "ix", "iy", "iz"], "left")
    return met.groupBy(*keys, key).agg(F.sum(F.col("w") * F.coalesce(value, F.lit(0.0))).alias(value))


def deposit_and_gather(points: DataFrame, q: dict[str, Column], h: Column, value: str, keys: tuple[str, ...], key: str = "indx") -> DataFrame:
    """H1: (*keys, key, value): gather() of what deposit_adaptive() makes of the same points, in one aggregation by cell, to which points give and
    from which they read; so points that are dealt by the keys are not shuffled again."""
    rows = points.select(*keys, key, *(q[c].cast("double").alias(f"q{c}") for c in "xyz"), F.greatest(F.coalesce(h, F.lit(0.5)), F.lit(0.5)).alias("h"), F.lit(0.0).alias("r2"))
    low = {c: F.floor(f"q{c}") for c in "xyz"}
    share = {c: (1 - (F.col(f"q{c}") - low[c]), F.col(f"q{c}") - low[c]) for c in "xyz"}
    eight = [F.struct(*((low[c] + d).cast("long").alias(c) for c, d in zip("xyz", o)), (share["x"][o[0]] * share["y"][o[1]] * share["z"][o[2]]).alias("w")) for o in product((0, 1), repeat=3)]
    gives = F.lit(None).cast("struct<x: bigint, y: bigint, z: bigint, w: double>")
    rows = rows.withColumn("_e", F.explode(F.array(gives, *eight))).withColumn("_reads", F.col("_e").isNotNull())
    for c in "xyz":
        span = [F.when(F.col("_reads"), F.col(f"_e.{c}")).otherwise(end) for end in (F.ceil(F.col(f"q{c}") - 2 * F.col("h")), F.floor(F.col(f"q{c}") + 2 * F.col("h")))]
        rows = rows.withColumn(f"i{c}", F.explode(F.sequence(*span)))
        d = F.col(f"i{c}") - F.col(f"q{c}")
        rows = rows.withColumn("r2", F.col("r2") + d * d).filter(F.col("_reads") | (F.col("r2") < 4 * F.col("h") * F.col("h")))
    read = F.collect_list(F.when(F.col("_reads"), F.struct(key, F.col("_e.w").alias("w"))))
    cells = rows.groupBy(*keys, "ix", "iy", "iz").agg(F.sum(F.when(~F.col("_reads"), w4_kernel(F.sqrt("r2"), F.col("h")))).alias(value), read.alias("_read"))
    met = cells.select(*keys, value, F.explode("_read").alias("_r"))
    return met.select(*keys, F.col(f"_r.{key}").alias(key), (F.col("_r.w") * F.coalesce(value, F.lit(0.0))).alias(value)).groupBy(*keys, key).agg(F.sum(value).alias(value))


def column_contour(cells: DataFrame, column: str, place: str, value: str, levels: int = 8) -> DataFrame:
    """(column, level, outside): for thresholds k/levels of each column's maximum, the mass outside the connected run above the threshold around the peak."""
    from pyspark.sql import Window

    by = Window.partitionBy(column)
    peak = cells.withColumn("_max", F.max(value).over(by)).withColumn("_peak", F.min(F.when(F.col(value) == F.max(value).over(by), F.col(place))).over(by))
    rows = peak.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    above = F.col(value) * levels >= F.col("level") * F.col("_max")
    rows = rows.withColumn("_low", (~above).cast("int")).withColumn("_run", F.sum("_low").over(Window.partitionBy(column, "level").orderBy(place)))
    own = rows.withColumn("_peak_run", F.max(F.when(F.col(place) == F.col("_peak"), F.col("_run"))).over(Window.partitionBy(column, "level")))
    inside = (F.col("_run") == F.col("_peak_run")) & (F.col("_low") == 0)
    return own.groupBy(column, "level").agg(F.sum(F.when(inside, 0).otherwise(F.col(value))).alias("outside"))
