"""Adaptive cells of groups: cubes halved until they hold few points, and walks over pairs of them.

A cell is addressed by its level and its place in it. Walks start with each group's root against itself and halve both sides level by
level, so a pair's cells are alike in size and no cell meets more than those around it: no key of a join is hot, however large the
group is. Groups of few points are one cell, and nothing of them is walked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Levels below the root; bits of a place in an address; members of a potential's leaf.
DEPTH, BITS, LEAF = 18, 19, 64
_CELL = ("at", "level", "kx", "ky", "kz", "leaf", "n", "sx", "sy", "sz")


def address(level: Column, kx: Column, ky: Column, kz: Column) -> Column:
    return ((level.cast("long") * (1 << BITS) + kx) * (1 << BITS) + ky) * (1 << BITS) + kz


def build(points: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(cells, packs) of points (g, id, x, y, z, ix, iy, iz): places at DEPTH halvings of the group's cube.

    cells: (g, at, level, kx, ky, kz, leaf, n, sx, sy, sz), sums of the points; leaves hold at most `leaf`, but for points that DEPTH halvings
    don't part. packs: (g, at, part, points), the points of each leaf in arrays of about `leaf`, usually one."""
    open_points, cells, held = cut(points), None, []
    for level in range(DEPTH + 1):
        keyed = open_points.withColumns({f"k{c}": F.shiftright(f"i{c}", DEPTH - level).cast("long") for c in "xyz"})
        now = keyed.groupBy("g", "kx", "ky", "kz").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "xyz"))
        now = now.withColumn("leaf", (F.col("n") <= leaf) | F.lit(level == DEPTH)).withColumn("level", F.lit(level))
        now = cut(now.select("g", address(F.col("level"), F.col("kx"), F.col("ky"), F.col("kz")).alias("at"), *_CELL[1:]))
        cells = now if cells is None else cells.unionByName(now)
        marked = cut(keyed.join(now.select("g", "kx", "ky", "kz", "at", "leaf", "n"), ["g", "kx", "ky", "kz"]).drop("kx", "ky", "kz"))
        held.append(marked.filter("leaf"))
        open_points = marked.filter("not leaf").drop("at", "leaf", "n")
        if open_points.isEmpty():
            break
    rows = held[0]
    for h in held[1:]:
        rows = rows.unionByName(h)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / leaf)).cast("int")
    packs = rows.groupBy("g", "at", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "x", "y", "z"))).alias("points"))
    return cut(cells), cut(packs)


def children(cells: DataFrame) -> DataFrame:
    """(g, at, kids) of each cell that is not a leaf."""
    up = address(F.col("level") - 1, *(F.shiftright(f"k{c}", 1) for c in "xyz"))
    return cut(cells.filter("level > 0").groupBy("g", up.alias("at")).agg(F.collect_list(F.struct(*_CELL)).alias("kids")))


def roots(cells: DataFrame) -> DataFrame:
    """(g, t, s): each group's root against itself."""
    return cells.filter("level = 0").select("g", F.struct(*_CELL).alias("t"), F.struct(*_CELL).alias("s"))


def halved(pairs: DataFrame, kids: DataFrame) -> DataFrame:
    """Pairs (g, t, s) of the children of both sides; a leaf stands for itself."""
    for side in "ts":
        joined = pairs.withColumn("at", F.col(f"{side}.at")).join(kids, ["g", "at"], "left")
        pairs = joined.withColumn(side, F.explode(F.coalesce("kids", F.array(side)))).select("g", "t", "s")
    return pairs


def _low(cell: str, c: str) -> Column:
    return F.col(f"{cell}.k{c}") / F.pow(F.lit(2.0), F.col(f"{cell}.level"))


def _width(cell: str) -> Column:
    return F.pow(F.lit(2.0), -F.col(f"{cell}.level"))


def tree_potential(members: DataFrame, eps: float, theta: float = 0.5, leaf: int = LEAF, group: str = "hid") -> DataFrame:
    """(g, id, pe): the sum over the group's other members of -1/sqrt(r^2 + eps^2), far cells of members taken at their centres of mass.

    A cell is far from another when its points are at most theta times as far from their centre of mass as that is from the other
    cell. The centre of mass leaves no error of first order, so each far cell's part, and with it the whole, is off by at
    most theta^2 / (1 - theta), and usually by a hundredth of that, as signs differ. Rows of pairs grow with the members, times
    the levels."""
    size = F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).cast("double")
    cubes = members.groupBy(F.col(group).alias("g")).agg(*(F.min(c).cast("double").alias(f"o{c}") for c in "xyz"), F.when(size > 0, size * (1 + 1e-9)).otherwise(1.0).alias("size"))
    at = {c: (F.col(c) - F.col(f"o{c}")) / F.col("size") for c in "xyz"}
    rows = members.select(F.col(group).alias("g"), F.col("indx").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz")).join(cubes, "g")
    points = rows.select("g", "id", *(at[c].alias(c) for c in "xyz"), *(F.least(F.floor(at[c] * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).alias(f"i{c}") for c in "xyz"))
    cells, packs = build(points, leaf)
    kids, now, far, near = children(cells), roots(cells), None, None
    mid = {c: F.col(f"s.s{c}") / F.col("s.n") for c in "xyz"}
    gap = [F.greatest(_low("t", c) - mid[c], mid[c] - _low("t", c) - _width("t"), F.lit(0.0)) for c in "xyz"]
    reach = [F.greatest(mid[c] - _low("s", c), _low("s", c) + _width("s") - mid[c]) for c in "xyz"]
    is_far = sum(r * r for r in reach) <= theta * theta * sum(d * d for d in gap)
    while True:
        judged = cut(now.withColumn("far", is_far))
        taken = judged.filter("far").groupBy("g", F.col("t.at").alias("at")).agg(F.collect_list(F.struct(*(mid[c].alias(c) for c in "xyz"), F.col("s.n").cast("double").alias("w"))).alias("cells"))
        met = judged.filter("not far and t.leaf and s.leaf").select("g", F.col("t.at").alias("at"), F.col("s.at").alias("other"))
        far, near = (taken, met) if far is None else (far.unionByName(taken), near.unionByName(met))
        now = judged.filter("not far and not (t.leaf and s.leaf)").select("g", "t", "s")
        if now.isEmpty():
            break
        now = halved(now, kids)
    leaves = cells.filter("leaf").select("g", "at", F.explode(F.sequence(F.lit(0), "level")).alias("up"), "level", "kx", "ky", "kz")
    over = leaves.select("g", F.col("at").alias("leaf"), address(F.col("up"), *(F.expr(f"shiftright(k{c}, level - up)") for c in "xyz")).alias("at"))
    sources = over.join(far, ["g", "at"]).select("g", F.col("leaf").alias("at"), F.lit(-1).alias("from"), *(F.col(f"cells.{c}").alias(c) for c in "xyz"), F.col("cells.w").alias("w"))
    own = packs.select("g", F.col("at").alias("other"), "part", *(F.col(f"points.{c}").alias(c) for c in "xyz"))
    direct = near.join(own, ["g", "other"]).select("g", "at", F.when(F.col("at") == F.col("other"), F.col("part")).otherwise(-1).alias("from"), "x", "y", "z", F.lit(None).cast("array<double>").alias("w"))
    parts = packs.select("g", "at", "part")
    sources = sources.unionByName(direct).join(parts, ["g", "at"]).select("g", "at", "part", F.lit(1).alias("kind"), (F.col("from") == F.col("part")).alias("same"), F.lit(None).cast("array<long>").alias("id"), "x", "y", "z", "w", F.lit(None).cast("double").alias("size"))
    targets = packs.join(cubes.select("g", "size"), "g").select("g", "at", "part", F.lit(0).alias("kind"), F.lit(False).alias("same"), F.col("points.id").alias("id"), *(F.col(f"points.{c}").alias(c) for c in "xyz"), F.lit(None).cast("array<double>").alias("w"), "size")

    def run(batches):
        held = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held[1]), held[0])), pa.array(held[1]), pa.array(-held[4])], names=["g", "id", "pe"])

        for b in batches:
            g, kind, same = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "kind", "same"))
            for k in range(b.num_rows):
                place = np.stack([b.column(c)[k].values.to_numpy() for c in "xyz"], axis=1)
                if kind[k] == 0:
                    if held:
                        yield out()
                    held = (g[k], b.column("id")[k].values.to_numpy(), place, b.column("size")[k].as_py(), np.zeros(len(place)))
                    continue
                _, _, mine, scale, total = held
                w = b.column("w")[k].values
                for s in range(0, len(place), 4096):
                    d = (mine[:, None, :] - place[None, s : s + 4096, :]) * scale
                    f = 1 / np.sqrt(np.einsum("ijk,ijk->ij", d, d) + eps * eps)
                    total += f.sum(axis=1) if w is None else f @ w.to_numpy()[s : s + 4096]
                if same[k]:
                    total -= 1 / eps
        if held:
            yield out()

    both = targets.unionByName(sources)
    tasks = max(1, -(-packs.count() // 256))
    return both.repartition(tasks, "g", "at", "part").sortWithinPartitions("g", "at", "part", "kind").mapInArrow(run, "g long, id long, pe double")


def nearest(points: DataFrame, k: int, box: int, leaf: int = 256) -> DataFrame:
    """(g, id, other, r2, rank): the k nearest others of each of the points (g, id, x, y, z; whole numbers in the periodic box) in its group,
    all of them in smaller groups; ties rank by id.

    At each level a cell keeps those that may hold one of its points' k nearest: what is farther than the distance within which
    the kept cells hold k others for sure is left out. So a lone point far off meets the near side of its group only."""
    places = points.select("g", "id", "x", "y", "z", *(F.expr(f"cast({c} * {1 << DEPTH} div {box} as bigint)").alias(f"i{c}") for c in "xyz"))
    cells, packs = build(places, leaf)
    small = roots(cells).filter("t.leaf").select("g", F.col("t.at").alias("at"), F.col("s.at").alias("other"))
    kids, now, met = children(cells), roots(cells).filter("not t.leaf"), small
    wide = (_width("t") + _width("s")) / 2

    def apart(c: str) -> Column:
        d = F.abs(_low("t", c) + _width("t") / 2 - _low("s", c) - _width("s") / 2)
        return F.least(d, 1 - d)

    least = sum(F.greatest(apart(c) - wide, F.lit(0.0)) * F.greatest(apart(c) - wide, F.lit(0.0)) for c in "xyz")
    most = sum(F.least(apart(c) + wide, F.lit(0.5)) * F.least(apart(c) + wide, F.lit(0.5)) for c in "xyz")
    while not now.isEmpty():
        split = halved(now, kids).select("g", "t", "s", least.alias("least"), most.alias("most"))
        cell = Window.partitionBy("g", "t.at")
        sure = F.min(F.when(F.col("sum") >= k + 1, F.col("most"))).over(cell)  # the cell's own points count, of which one is the point itself
        kept = split.withColumn("sum", F.sum("s.n").over(cell.orderBy("most").rangeBetween(Window.unboundedPreceding, 0))).withColumn("sure", sure)
        kept = cut(kept.filter("sure is null or least <= sure * 1.000001").select("g", "t", "s"))
        met = met.unionByName(kept.filter("t.leaf and s.leaf").select("g", F.col("t.at").alias("at"), F.col("s.at").alias("other")))
        now = kept.filter("not (t.leaf and s.leaf)")
    own = packs.select("g", F.col("at").alias("other"), *(F.col(f"points.{c}").alias(c) for c in ("id", "x", "y", "z")))
    parts = packs.select("g", "at", "part", F.col("points").alias("mine"))
    work = met.join(own, ["g", "other"]).select("g", "at", F.lit(1).alias("kind"), "id", "x", "y", "z").join(packs.select("g", "at", "part"), ["g", "at"])
    targets = parts.select("g", "at", F.lit(0).alias("kind"), *(F.col(f"mine.{c}").alias(c) for c in ("id", "x", "y", "z")), "part")
    names = ["g", "id", "other", "r2", "rank"]

    def run(batches):
        mine, best = None, None

        def out():
            g, ids, _ = mine
            r2, other = best
            order = np.lexsort((other, r2), axis=1)
            r2, other = (np.take_along_axis(v, order, axis=1)[:, :k] for v in (r2, other))
            row, col = np.nonzero(r2 >= 0)
            good = r2[row, col] < np.iinfo(np.int64).max
            row, col = row[good], col[good]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(row), g), ids[row], other[row, col], r2[row, col], (col + 1).astype(np.int32))], names=names)

        for b in batches:
            g, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "kind"))
            for j in range(b.num_rows):
                ids, place = b.column("id")[j].values.to_numpy(), np.stack([b.column(c)[j].values.to_numpy() for c in "xyz"], axis=1)
                if kind[j] == 0:
                    if mine:
                        yield out()
                    mine = (g[j], ids, place)
                    best = np.full((len(ids), 0), 0, np.int64), np.full((len(ids), 0), 0, np.int64)
                    continue
                d = np.abs(mine[2][:, None, :] - place[None, :, :])
                d = np.minimum(d, box - d)
                r2 = np.einsum("ijk,ijk->ij", d, d)
                r2[mine[1][:, None] == ids[None, :]] = np.iinfo(np.int64).max
                r2, other = np.concatenate([best[0], r2], axis=1), np.concatenate([best[1], np.broadcast_to(ids, r2.shape)], axis=1)
                if r2.shape[1] > 2 * k + 512:  # keep the k best, ties by id
                    order = np.lexsort((other, r2), axis=1)[:, :k]
                    r2, other = np.take_along_axis(r2, order, axis=1), np.take_along_axis(other, order, axis=1)
                best = r2, other
        if mine:
            yield out()

    tasks = max(1, -(-packs.count() // 256))
    both = targets.unionByName(work.select(targets.columns))
    return both.repartition(tasks, "g", "at", "part").sortWithinPartitions("g", "at", "part", "kind").mapInArrow(run, "g long, id long, other long, r2 long, rank int")
