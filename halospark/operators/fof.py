"""Friends-of-friends groups in a periodic box."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .graph import components, joined


#: Candidate pairs that are looked at together; points of a cell that are tried before all of them are.
TOGETHER, GLANCE = 4_000_000, 4


#: Half of the cells, of an edge of a link's length over the root of 3, that a link can reach, the nearest first.
_REACH = sorted((o for o in product(range(-2, 3), repeat=3) if o > (0, 0, 0)), key=lambda o: sum(v * v for v in o))


def local_labels(ids: np.ndarray, pos: np.ndarray, b: float) -> np.ndarray:
    """The smallest id of each point's group, linking points at most b apart.

    Cells are so small that all points of one are linked, so sets are of cells. The points of two cells are compared, TOGETHER pairs at
    a time and the nearest cells first, only while these are in different sets, a few points of each before all; so a dense cluster costs about
    its cells, not its pairs."""
    n = len(ids)
    if n < 2:
        return ids.copy()
    f = b / math.sqrt(3) * (1 - 1e-9)
    cell = np.floor((pos - pos.min(axis=0)) / f).astype(np.int64)
    side = cell.max(axis=0) + 5
    key = (cell[:, 0] * side[1] + cell[:, 1]) * side[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
    axes, m = np.ascontiguousarray(pos[order].T), len(keys)
    up = np.arange(m)  # the smallest cell of a cell's set

    def meet(one, two, held):
        """Joins cells one[k] and two[k] where the first `held` points of each have a link."""
        nonlocal up
        size = held[one] * held[two]
        s = 0
        while s < len(one):
            e = max(s + 1, int(np.searchsorted(np.cumsum(size[s:]), TOGETHER, "right")) + s)
            now = s + np.flatnonzero(up[one[s:e]] != up[two[s:e]])  # others were joined meanwhile
            s = e
            if len(now) == 1 and size[now[0]] > TOGETHER:
                u, v = (slice(first[c[now[0]]], first[c[now[0]]] + count[c[now[0]]]) for c in (one, two))
                rows = max(1, TOGETHER // count[two[now[0]]])
                if any((sum((p[u][k : k + rows, None] - p[v]) ** 2 for p in axes) <= b * b).any() for k in range(0, count[one[now[0]]], rows)):
                    up = joined(up, one[now], two[now])
                continue
            pair = np.repeat(now, size[now])
            at = np.arange(len(pair)) - np.repeat(np.cumsum(size[now]) - size[now], size[now])
            i, j = first[one[pair]] + at // held[two[pair]], first[two[pair]] + at % held[two[pair]]
            near = sum((p[i] - p[j]) ** 2 for p in axes) <= b * b
            found = np.unique(pair[near])
            up = joined(up, one[found], two[found])

    for o in _REACH:
        to = keys + (o[0] * side[1] + o[1]) * side[2] + o[2]
        there = np.minimum(np.searchsorted(keys, to), m - 1)
        one = np.flatnonzero((keys[there] == to) & (up[there] != up))
        meet(one, there[one], np.minimum(count, GLANCE))
        one = one[(up[one] != up[there[one]]) & (np.maximum(count[one], count[there[one]]) > GLANCE)]
        meet(one, there[one], count)
    least = np.full(m, np.iinfo(np.int64).max)
    cells = np.repeat(np.arange(m), count)
    np.minimum.at(least, up[cells], ids[order])
    out = np.empty(n, np.int64)
    out[order] = least[up[cells]]
    return out


def _blocks(df: DataFrame, b: int, box: int, edge: int) -> DataFrame:
    """Rows of df dealt to blocks of the given edge, and copies (ghosts) in each block they are at most b away from, moved next to it.
    _own: the row's own block; _shared: it has copies."""
    n = box // edge
    df = df.withColumns({"_own": F.lit(True), "_shared": F.lit(False)})
    for c in "xyz":
        own = F.expr(f"{c} div {edge}")
        low, high = F.col(c) - own * edge <= b, (own + 1) * edge - F.col(c) <= b
        options = F.array_compact(F.array(own, F.when(low, own - 1), F.when(high, own + 1)))
        df = df.withColumns({f"_b{c}": F.explode(options), "_shared": F.col("_shared") | low | high}).withColumn("_own", F.col("_own") & (F.col(f"_b{c}") == own))
        df = df.withColumn(f"_p{c}", F.when(F.col(f"_b{c}") < 0, F.col(c) + box).when(F.col(f"_b{c}") >= n, F.col(c) - box).otherwise(F.col(c)))
        df = df.withColumn(f"_b{c}", F.pmod(F.col(f"_b{c}"), F.lit(n)))
    return df.withColumn("_block", (F.col("_bx") * n + F.col("_by")) * n + F.col("_bz"))


def _halvings(rows: DataFrame, b: int, edge: int, most: int) -> DataFrame:
    """(_bx, _by, _bz, _k): how often blocks of over `most` rows (id, x, y, z) are halved along each axis: until no part has more, or until
    parts would be under 2 b + 1 wide."""
    deepest = 0
    while edge % (2 << deepest) == 0 and edge >> (deepest + 1) > 2 * b:
        deepest += 1
    block = [F.expr(f"{c} div {edge}").alias(f"_b{c}") for c in "xyz"]
    if not deepest:
        return rows.select(*block, F.lit(0).alias("_k")).limit(0)
    fine = rows.groupBy(*block, *(F.expr(f"({c} % {edge}) div {edge >> deepest}").alias(f"_s{c}") for c in "xyz")).agg(F.count("*").alias("n"))
    over = fine.groupBy("_bx", "_by", "_bz").agg(F.sum("n").alias("all")).filter(F.col("all") > most).select("_bx", "_by", "_bz")
    fine = cut(fine.join(over, ["_bx", "_by", "_bz"], "left_semi"))
    enough = None
    for k in range(1, deepest + 1):
        parts = fine.groupBy("_bx", "_by", "_bz", *(F.shiftright(f"_s{c}", deepest - k).alias(f"_s{c}") for c in "xyz")).agg(F.sum("n").alias("n"))
        largest = parts.groupBy("_bx", "_by", "_bz").agg(F.max("n").alias("n")).filter((F.col("n") <= most) | F.lit(k == deepest)).select("_bx", "_by", "_bz", F.lit(k).alias("_k"))
        enough = largest if enough is None else enough.unionByName(largest)
    return cut(enough.groupBy("_bx", "_by", "_bz").agg(F.min("_k").alias("_k")))


def _parts(df: DataFrame, b: int, box: int, edge: int, halvings: DataFrame) -> DataFrame:
    """As _blocks(), but blocks in halvings are cut in parts: a row goes to the parts of a block between b below and b above it along each
    axis, and to no part twice."""
    df = _blocks(df, b, box, edge).join(halvings, ["_bx", "_by", "_bz"], "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    for c in "xyz":
        inside = F.col(f"_p{c}") - F.col(f"_b{c}") * edge
        ends = (F.least(F.greatest(inside + d, F.lit(0)), F.lit(edge - 1)).cast("long") for d in (-b, b))
        df = df.withColumns({f"_from{c}": next(ends), f"_to{c}": next(ends)}).withColumns({v: F.expr(f"{v} div shiftright({edge}, _k)") for v in (f"_from{c}", f"_to{c}")})
        df = df.withColumns({"_shared": F.col("_shared") | (F.col(f"_from{c}") < F.col(f"_to{c}")), f"_s{c}": F.explode(F.sequence(f"_from{c}", f"_to{c}"))})
        df = df.withColumn("_own", F.col("_own") & (F.expr(f"cast(_p{c} - _b{c} * {edge} as long) div shiftright({edge}, _k)") == F.col(f"_s{c}")))
        df = df.withColumn("_block", F.col("_block") * edge + F.col(f"_s{c}"))
    return df


def block_edge(b: int, box: int, blocks: int) -> int:
    """The edge of about `blocks` blocks per axis, at least 3, that divide the box and are over 2 b wide."""
    fit = [n for n in range(3, max(4, box // (2 * b + 1) + 1)) if box % n == 0]
    return box // max([n for n in fit if n <= blocks] or fit[:1] or [1])


#: Particles of a block, on average, at most.
BLOCK_ROWS = 200_000


def fof_groups(particles: DataFrame, b: int, box: int, blocks: int | None = None, key: str = "indx", most: int = 2 * BLOCK_ROWS) -> DataFrame:
    """(key, label): the smallest key of each particle's group, linking particles at most b apart (inclusive, periodic).

    Blocks with ghosts of width b are grouped by themselves, one task's rows at a time; ghosts that got two labels give edges
    of a graph of labels, which only holds labels at block faces and whose components merge the groups. Only rows that are in several blocks are
    put together by key, and only members of groups that have such rows meet the graph. The number of
    blocks an axis follows the particles' number by default, 8 at least, and sets how many a task holds at once; a block of over `most`
    particles is halved until its parts hold no more, as far as the linking length lets it."""
    if blocks is None:
        blocks = max(8, math.ceil((particles.count() / BLOCK_ROWS) ** (1 / 3)))
    edge = block_edge(b, box, blocks)
    if box // edge < 3:
        raise ValueError("the box is less than three blocks wide")
    rows = particles.select(F.col(key).alias("id"), "x", "y", "z")
    halvings = _halvings(rows, b, edge, most)
    dealt = _blocks(rows, b, box, edge) if halvings.isEmpty() else _parts(rows, b, box, edge, halvings)
    dealt = dealt.select("_block", "id", F.col("_px").cast("double").alias("x"), F.col("_py").cast("double").alias("y"), F.col("_pz").cast("double").alias("z"), F.col("_shared").alias("shared"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, shared = pdf["id"].to_numpy(np.int64), pdf["shared"].to_numpy(bool)
        label = local_labels(ids, pdf[["x", "y", "z"]].to_numpy(float), float(b))
        return pd.DataFrame({"id": ids, "label": label, "shared": shared, "met": np.isin(label, label[shared])})

    local = cut(dealt.groupBy("_block").applyInPandas(group, "id long, label long, shared boolean, met boolean"))
    copies = local.filter("shared").select("id", "label")
    label = copies.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    edges = copies.join(label.filter("label <> other").select("id", F.col("label").alias("low")), "id").select(F.col("label").alias("a"), F.col("low").alias("b"))
    roots = components(edges)
    open_ = local.filter("met and not shared").select("id", "label").unionByName(label.select("id", "label"))
    merged = open_.join(roots, F.col("label") == F.col("node"), "left").select("id", F.coalesce("root", "label").alias("label"))
    return local.filter("not met").select("id", "label").unionByName(merged).withColumnRenamed("id", key)


def boundary_class(particles: DataFrame, labels: DataFrame, b: int, slab: int, key: str = "indx") -> DataFrame:
    """(slab, label, class) of the groups in each slab of the given thickness along z: bit 1 if a member is at most b from
    the slab's bottom, bit 2 from its top; 0 means that no other slab can add to the group."""
    rows = particles.join(labels, key).withColumn("slab", F.expr(f"z div {slab}"))
    low = F.max((F.col("z") - F.col("slab") * slab <= b).cast("int"))
    high = F.max((((F.col("slab") + 1) * slab - F.col("z")) <= b).cast("int"))
    return rows.groupBy("slab", "label").agg((low + 2 * high).alias("class"))


def unwrap(members: DataFrame, b: int, box: int, group: str = "hid") -> DataFrame:
    """Members with x, y, z moved so that no group is cut by the box's faces.

    Where a group touches both faces of an axis, it is cut at the first gap over 1.5 b along it, and the part above is moved down by the
    box. Gaps are looked for between bins no wider than that, from their least and greatest places, so no group is sorted."""
    wide = max(1, int(1.5 * b))
    touch = members.groupBy(group).agg(*(((F.min(c) <= b) & (F.max(c) >= box - b)).alias(f"_cut{c}") for c in "xyz")).filter("_cutx or _cuty or _cutz")
    along = F.array_compact(F.array(*(F.when(F.col(f"_cut{c}"), F.struct(F.lit(c).alias("_axis"), F.col(c).alias("_v"))) for c in "xyz")))
    flagged = members.join(touch, group).select(group, F.explode(along).alias("_e")).select(group, "_e.*")
    bins = flagged.groupBy(group, "_axis", F.floor(F.col("_v") / wide).alias("_bin")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = F.lag("_high").over(Window.partitionBy(group, "_axis").orderBy("_bin"))  # box / wide bins at most
    gaps = bins.withColumn("_before", before).filter(F.col("_low") - F.col("_before") > 1.5 * b).groupBy(group).agg(*(F.min(F.when(F.col("_axis") == c, F.col("_low"))).alias(f"_from{c}") for c in "xyz"))
    moved = {c: F.when(F.col(c) >= F.col(f"_from{c}"), F.col(c) - box).otherwise(F.col(c)) for c in "xyz"}
    return members.join(gaps, group, "left").withColumns(moved).select(*members.columns)


#: Rows of a range, on average, at most.
RANGE_ROWS = 4_000_000


def numbered(ranged: DataFrame, name: str = "place") -> DataFrame:
    """Rows with their places from 0 in the order in which they are, partition after partition: their place in the partition and the
    counts of those before. The numbered rows are written."""
    rows = cut(ranged.withColumn("_m", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")  # a row for each partition
    placed = rows.join(F.broadcast(before), F.shiftright("_m", 33) == F.col("_p"))
    return placed.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_before")


def dense_numbers(df: DataFrame, order: list, name: str = "hid", partitions: int | None = None) -> DataFrame:
    """Df with dense numbers from 0 in the given order, without a window over the rows: ranges, as many as the rows need by
    default, are sorted and counted, and rows numbered from the counts of the ranges before."""
    if partitions is None:
        df = cut(df)
        partitions = max(8, -(-df.count() // RANGE_ROWS))
    return numbered(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order), name)


def prefof_filter(particles: DataFrame, b: int, box: int, cell: int, least: int = 20, key: str = "indx") -> DataFrame:
    """particles whose group inside their cell has `least` members or comes within b of the cell's wall; no other can be in a group of `least`."""
    rows = particles.select(F.col(key).alias("id"), "x", "y", "z").withColumn("_cell", F.expr(f"((x div {cell}) * {box // cell} + (y div {cell})) * {box // cell} + (z div {cell})"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pos, ids = pdf[["x", "y", "z"]].to_numpy(float), pdf["id"].to_numpy(np.int64)
        label = local_labels(ids, pos, float(b))
        inside = pos % cell
        wall = ((inside <= b) | (cell - inside <= b)).any(axis=1)
        by = pd.DataFrame({"label": label, "wall": wall}).groupby("label")["wall"].agg(["size", "max"])
        good = by.index[(by["size"] >= least) | by["max"]]
        return pd.DataFrame({"id": ids[np.isin(label, good)]})

    kept = rows.groupBy("_cell").applyInPandas(keep, "id long")
    return particles.join(kept, particles[key] == kept["id"], "left_semi")
