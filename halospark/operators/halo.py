"""Halo properties as aggregations over members."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import w4_kernel
from ..scratch import cut
from .grouped import by_group, pulls, runs_of, stacks
from .lookups import value_at_rank
from .octree import LEAF, tree_potential
from .pairs import knn_in_group


def catalog(members: DataFrame, group: str = "hid") -> DataFrame:
    """A1: np, sums and means of position and velocity."""
    cols = ("x", "y", "z", "vx", "vy", "vz")
    return members.groupBy(group).agg(F.count("*").alias("np"), *(F.sum(c).alias(f"s{c}") for c in cols)).select(group, "np", *(F.col(f"s{c}") for c in cols), *((F.col(f"s{c}") / F.col("np")).alias(c) for c in cols))


def bbox(members: DataFrame, group: str = "hid") -> DataFrame:
    """A2."""
    return members.groupBy(group).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def about_centre(members: DataFrame, group: str = "hid") -> DataFrame:
    """Members with positions and velocities about their group's means: dx, dy, dz, dvx, dvy, dvz."""
    means = members.groupBy(group).agg(*(F.avg(c).alias(f"_m{c}") for c in ("x", "y", "z", "vx", "vy", "vz")))
    both = members.join(means, group)
    return both.withColumns({f"d{c}": F.col(c) - F.col(f"_m{c}") for c in ("x", "y", "z", "vx", "vy", "vz")}).drop(*(f"_m{c}" for c in ("x", "y", "z", "vx", "vy", "vz")))


def kinetic(members: DataFrame, hubble: float, group: str = "hid") -> DataFrame:
    """Members with ke, half the squared velocity about the group's mean with the Hubble flow about its centre."""
    rows = about_centre(members, group)
    return rows.withColumn("ke", 0.5 * sum((F.col(f"dv{c}") + hubble * F.col(f"d{c}")) * (F.col(f"dv{c}") + hubble * F.col(f"d{c}")) for c in "xyz"))


def velocity_dispersion(members: DataFrame, hubble: float, group: str = "hid") -> DataFrame:
    """A3."""
    return kinetic(members, hubble, group).groupBy(group).agg(F.sqrt(2 * F.avg("ke")).alias("sigv"))


def angular_momentum(members: DataFrame, group: str = "hid") -> DataFrame:
    """A4: the sum of r x v about the means, its length and direction (null where the length is 0)."""
    rows = about_centre(members, group)
    cross = [F.sum(F.col(f"d{a}") * F.col(f"dv{b}") - F.col(f"d{b}") * F.col(f"dv{a}")) for a, b in (("y", "z"), ("z", "x"), ("x", "y"))]
    out = rows.groupBy(group).agg(*(c.alias(f"l{n}") for c, n in zip(cross, "xyz")))
    size = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz"))
    return out.withColumn("rotation", size).withColumns({f"u{n}": F.when(F.col("rotation") > 0, F.col(f"l{n}") / F.col("rotation")) for n in "xyz"})


def spin_parameter(members: DataFrame, energies: DataFrame, g: float, mass: float, group: str = "hid") -> DataFrame:
    """A4: |L| sqrt(-E) / (G m np^2.5), null where the total energy is positive."""
    both = angular_momentum(members, group).join(energies, group)
    e = F.when(F.col("total_energy") <= 0, F.sqrt(-F.col("total_energy")))
    return both.select(group, (F.col("rotation") * e / (g * mass * F.pow(F.col("np").cast("double"), F.lit(2.5)))).alias("spin"))


def shape_moments(members: DataFrame, group: str = "hid") -> DataFrame:
    """A5: the six second moments about the centre."""
    rows = about_centre(members, group)
    return rows.groupBy(group).agg(*(F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"m{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "yz", "xz")), F.count("*").alias("np"))


SHAPE = "q double, s double, d1 double, d2 double, d3 double, axes array<array<double>>"


def shape(members: DataFrame, group: str = "hid") -> DataFrame:
    """A5: axis ratios q = sqrt(d2/d1), s = sqrt(d3/d1) of the sorted eigenvalues of the moments, and right-handed axes. Null for groups at a point."""

    @F.pandas_udf(SHAPE)
    def solve(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, yz: pd.Series, xz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -1)
        d, v = np.linalg.eigh(m)
        d, v = np.maximum(d[:, ::-1], 0), v[:, :, ::-1]
        v = v * np.where(np.linalg.det(v) < 0, -1, 1)[:, None, None]
        with np.errstate(all="ignore"):
            q, s = np.sqrt(d[:, 1] / d[:, 0]), np.sqrt(d[:, 2] / d[:, 0])
        return pd.DataFrame({"q": q, "s": s, "d1": d[:, 0], "d2": d[:, 1], "d3": d[:, 2], "axes": [x.T.tolist() for x in v]})

    moments = shape_moments(members, group)
    return moments.withColumn("e", solve("mxx", "myy", "mzz", "mxy", "myz", "mxz")).select(group, "np", *(F.when(F.col("e.d1") > 0, F.col(f"e.{c}")).alias(c) for c in ("q", "s")), "e.d1", "e.d2", "e.d3", "e.axes")


def pair_potential(members: DataFrame, eps: float = 0.1, group: str = "hid", tile: int = 2000, exact: int | None = None, theta: float = 0.5) -> DataFrame:
    """Members with pe, the sum over the group's other members of -1/sqrt(r^2 + eps^2), exact but for groups of over `exact` members, if
    that is given: for these by octree.tree_potential(), with its error bound of theta^2 / (1 - theta).

    Groups of up to `tile` members are dealt whole to tasks, once, and summed there. Larger ones are cut in tiles of
    about that size, and each pair of tiles is a matrix of its own: a large halo becomes many tasks, none over tile^2 pairs.
    A tree of up to LEAF members is one cell that meets itself only, whose sum is the exact one, so these groups are summed whole too."""
    members = members.filter(F.col(group).isNotNull())
    small, large, _ = by_group(members, group, tile if exact is None else min(tile, max(exact, LEAF)))
    out = _summed_whole(small, eps, group)
    if large is None:
        return out
    if exact is None:
        return out.unionByName(_with_pe(large, _tiled(large, eps, group, tile), group))
    over = cut(large.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > exact).select(group))
    far = large.join(over, group, "left_semi")
    out = out.unionByName(_with_pe(far, tree_potential(far, eps, theta, group=group), group))
    rest = large.join(over, group, "left_anti")
    return out.unionByName(_with_pe(rest, _tiled(rest, eps, group, tile), group)) if exact > tile else out


def _with_pe(members: DataFrame, pe: DataFrame, group: str) -> DataFrame:
    return members.join(pe, (members[group] == pe["g"]) & (members["indx"] == pe["id"])).drop("g", "id")


def _summed_whole(members: DataFrame, eps: float, group: str) -> DataFrame:
    """Members, dealt by group, with pe; groups of one size are done together."""

    def run(batches):
        for rows, ends in runs_of(batches, group):
            place, pe = np.stack([rows[c].cast(pa.float64(), safe=False).to_numpy() for c in "xyz"], axis=1), np.zeros(rows.num_rows)
            starts = np.append(0, ends[:-1])
            for at in stacks(starts, ends - starts):
                pe[at] = -pulls(place[at], eps)
            yield from rows.append_column("pe", pa.array(pe)).to_batches()

    return members.sortWithinPartitions(group, "indx").mapInArrow(run, T.StructType([*members.schema.fields, T.StructField("pe", T.DoubleType())]))


def _tiled(members: DataFrame, eps: float, group: str, tile: int) -> DataFrame:
    """(g, id, pe) of groups of over `tile` members."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    rows = cut(members.join(sizes, group).select(F.col(group).alias("g"), F.col("indx").alias("id"), *(F.col(c).cast("double") for c in "xyz"), "_tiles"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    left = rows.select("g", F.col("_own").alias("i"), F.col("_other").alias("j"), F.lit(True).alias("left"), "id", "x", "y", "z")
    right = rows.select("g", F.col("_other").alias("i"), F.col("_own").alias("j"), F.lit(False).alias("left"), "id", "x", "y", "z")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        pa_, pb = a[["x", "y", "z"]].to_numpy(), b[["x", "y", "z"]].to_numpy()
        out = np.zeros(len(a))
        for k in range(0, len(a), 256):
            d2 = ((pa_[k : k + 256, None, :] - pb[None, :, :]) ** 2).sum(axis=2)
            f = 1 / np.sqrt(d2 + eps * eps)
            f[a["id"].to_numpy()[k : k + 256, None] == b["id"].to_numpy()[None, :]] = 0
            out[k : k + 256] = -f.sum(axis=1)
        return pd.DataFrame({"g": a["g"], "id": a["id"], "pe": out})

    tiles = left.unionByName(right).groupBy("g", "i", "j").applyInPandas(sums, "g long, id long, pe double")
    return tiles.groupBy("g", "id").agg(F.sum("pe").alias("pe"))


def kinetic_total(particles: DataFrame) -> DataFrame:
    """The sum of squared velocities, and the number of particles."""
    return particles.agg(F.sum(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")).alias("kinetic"), F.count("*").alias("n"))


def most_bound(members: DataFrame, energy, group: str = "hid") -> DataFrame:
    """The member with the least energy of each group; of equal ones that with the smallest indx."""
    return members.groupBy(group).agg(F.min(F.struct(energy.alias("e"), "indx")).alias("m")).select(group, F.col("m.indx").alias("mbp"), F.col("m.e").alias("e"))


def virial_ratio(energies: DataFrame, group: str = "hid") -> DataFrame:
    """kw = 2 K / (P/2) + 1 and the total energy K + P/2, of members with ke and pe. Null kw where P is 0."""
    k, p = F.sum("ke"), F.sum("pe") / 2
    return energies.groupBy(group).agg(F.count("*").alias("np"), F.when(p != 0, 2 * k / p + 1).alias("kw"), (k + p).alias("total_energy"))


def radius_of(members: DataFrame, part: float = 0.98, group: str = "hid") -> DataFrame:
    """The distance from the centre that holds the given part of the members: that of rank ceil(part * np)."""
    r = about_centre(members, group).withColumn("r", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return value_at_rank(r, group, "r", part).withColumnRenamed("r", "radius")


def ellipsoidal_radius(members: DataFrame, part: float = 0.98, group: str = "hid") -> DataFrame:
    """The same with the distance sqrt(x^2 + (y/q)^2 + (z/s)^2) along the group's axes; flat groups (s under 1e-5) are left out."""
    axes = shape(members, group).filter("s >= 1e-5").select(group, "q", "s", "axes")
    rows = about_centre(members, group).join(axes, group)
    along = [sum(F.col("axes")[k][j] * F.col(f"d{c}") for j, c in enumerate("xyz")) for k in range(3)]
    r = rows.withColumn("r", F.sqrt(along[0] * along[0] + (along[1] / F.col("q")) * (along[1] / F.col("q")) + (along[2] / F.col("s")) * (along[2] / F.col("s"))))
    return value_at_rank(r, group, "r", part).withColumnRenamed("r", "radius")


def halo_properties(members: DataFrame, hubble: float, eps: float = 0.1, g: float = 1.0, mass: float = 1.0, group: str = "hid") -> DataFrame:
    """A10: one row of all properties for each group. Members are written once and read by each part."""
    members = cut(members)
    bound = kinetic(members, hubble, group).select(group, "indx", "ke").join(pair_potential(members, eps, group).select(F.col(group), "indx", (F.col("pe") * g * mass).alias("pe")), [group, "indx"])
    energies = virial_ratio(bound, group)
    mbp = most_bound(bound, F.col("ke") + F.col("pe"), group).select(group, "mbp")
    out = catalog(members, group).select(group, "np", "x", "y", "z", "vx", "vy", "vz", (F.col("np") * mass).alias("mass"))
    for part in (mbp, velocity_dispersion(members, hubble, group), angular_momentum(members, group).select(group, "rotation", "ux", "uy", "uz"), energies.select(group, "kw", "total_energy"), spin_parameter(members, energies, g, mass, group), shape(members, group).select(group, "q", "s"), radius_of(members, 0.98, group)):
        out = out.join(part, group, "left")
    return out


def sph_density(members: DataFrame, k: int, box: int, group: str = "hid") -> DataFrame:
    """(group, indx, density): the kernel summed over the k nearest others and the row itself, of radius the distance of the k-th.

    Where the k-th is at the same place the density has no bound and is null, and so it is for the only member of a group."""
    near = knn_in_group(members, k, box, group).groupBy(group, F.col("id").alias("indx")).agg(F.sort_array(F.collect_list("r2")).alias("r2"))  # k numbers
    found = near.withColumn("h", F.nullif(F.sqrt(F.array_max("r2").cast("double")) / 2, F.lit(0.0))).filter("h is not null")
    others = F.aggregate("r2", F.lit(0.0), lambda total, r2: total + w4_kernel(F.sqrt(r2.cast("double")), F.col("h")))
    found = found.select(group, "indx", (others + w4_kernel(F.lit(0.0), F.col("h"))).alias("density"))
    return members.select(group, "indx").join(found, [group, "indx"], "left")


def density_peak(members: DataFrame, density: DataFrame, group: str = "hid") -> DataFrame:
    """The member with the highest density of each group (of equal ones that with the smallest indx)."""
    best = members.join(density, [group, "indx"]).groupBy(group).agg(F.max(F.struct("density", (-F.col("indx")).alias("n"), "x", "y", "z")).alias("b"))
    return best.select(group, (-F.col("b.n")).alias("indx"), "b.density", "b.x", "b.y", "b.z")
