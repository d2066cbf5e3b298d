"""Merger trees from links: one row for each line and step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .fof import RANGE_ROWS, dense_numbers
from .massfunc import histogram_quantiles, mass_function


def build_tree(links: DataFrame, partitions: int | None = None) -> DataFrame:
    """Links with gid, a number for each unbroken line of an MBP, and majorgid, that of its host's heaviest.

    A line is an island of consecutive steps of one mbp; islands are numbered by first step and mbp. A lost MBP that comes back
    begins a new line."""
    by = Window.partitionBy("mbp").orderBy("step")
    new = (F.col("step") - F.coalesce(F.lag("step").over(by), F.lit(-10)) > 1).cast("int")
    rows = links.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by))
    heads = rows.groupBy("mbp", "_island").agg(F.min("step").alias("_birth"))
    numbered = dense_numbers(heads, [F.col("_birth"), F.col("mbp")], "gid", partitions).select("mbp", "_island", "gid")
    return major_gid(rows.join(numbered, ["mbp", "_island"]).drop("_new", "_island"))


def major_gid(tree: DataFrame) -> DataFrame:
    """The gid of the heaviest MBP of each host, of equal ones the smallest gid."""
    w = Window.partitionBy("step", "nowhid").orderBy(F.desc("mass"), "gid")
    return tree.withColumn("majorgid", F.first("gid").over(w))


def propagate_gid(tree: DataFrame) -> DataFrame:
    """Rows of lines that go on, with the gid one step before: they must be equal, as must be the mbp."""
    before = tree.select((F.col("step") + 1).alias("step"), "mbp", F.col("gid").alias("gid_before"))
    return tree.join(before, ["step", "mbp"]).select("step", "mbp", "gid", "gid_before")


def sort_by_major(tree: DataFrame, step: int, partitions: int | None = None) -> DataFrame:
    """Tree with new gids, dense in the order of majorgid at the given step (lines without one last), then gid; majorgids follow."""
    lines = tree.groupBy("gid").agg(F.max(F.when(F.col("step") == step, F.col("majorgid"))).alias("_major"))
    lines = lines.withColumn("_order", F.coalesce("_major", F.lit(2**62)))
    new = dense_numbers(lines, [F.col("_order"), F.col("gid")], "newgid", partitions).select("gid", "newgid")
    both = tree.join(new, "gid").join(new.select(F.col("gid").alias("majorgid"), F.col("newgid").alias("newmajor")), "majorgid")
    return both.drop("gid", "majorgid").withColumnsRenamed({"newgid": "gid", "newmajor": "majorgid"})


def finalize(tree: DataFrame, partitions: int | None = None) -> DataFrame:
    """T4: non-empty histories, sorted by gid and step in ranges, as many as the rows need by default."""
    from .filters import drop_empty_histories

    kept = drop_empty_histories(tree)
    if partitions is None:
        kept = cut(kept)
        partitions = max(1, -(-kept.count() // RANGE_ROWS))
    return kept.repartitionByRange(partitions, "gid").sortWithinPartitions("gid", "step")


def histories(tree: DataFrame, cols: list[str]) -> DataFrame:
    """One row for each gid with its steps in order."""
    return tree.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("step", *cols))).alias("history"))


def attach_phase_space(tree: DataFrame, mbp_rows: DataFrame, host_rows: DataFrame) -> DataFrame:
    """Tree with position and velocity of the MBP (step, indx, x, ...) and of its host (step, hid, hx, ...)."""
    return tree.join(mbp_rows.withColumnRenamed("indx", "mbp"), ["step", "mbp"], "left").join(host_rows.withColumnRenamed("hid", "nowhid"), ["step", "nowhid"], "left")


def attach_quantity(tree: DataFrame, quantities: DataFrame) -> DataFrame:
    """Tree with what is known of its host by (step, hid)."""
    return tree.join(quantities.withColumnRenamed("hid", "nowhid"), ["step", "nowhid"], "left")


def accretion(tree: DataFrame, last: int, samples: list[tuple[float, float]], bins: int = 1024, quantiles=(0.317, 0.5, 0.683), least: int = 10) -> DataFrame:
    """For each range of final mass and step, the quantiles of M/M0 over lines, by a histogram of `bins` bins on (0, 1]."""
    final = tree.filter(F.col("step") == last).select("gid", F.col("mass").alias("m0"))
    sample = F.array(*(F.struct(F.lit(k).alias("sample"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(samples)))
    rows = tree.join(final, "gid").withColumn("s", F.explode(sample)).filter("m0 >= s.a and m0 < s.b")
    ratio = F.least(F.floor(F.col("mass") * bins / F.col("m0")), F.lit(bins - 1)).cast("long")
    return histogram_quantiles(rows.select(F.col("s.sample").alias("sample"), "step", ratio.alias("bin")), ["sample", "step"], "bin", list(quantiles), least)


def accretion_slope(tree: DataFrame, last: int, redshift, samples: list[tuple[float, float]], bins: int = 1024, top: float = 5.0, quantiles=(0.317, 0.5, 0.683), least: int = 10) -> DataFrame:
    """The same for psi = -ln(M/M0)/z on [0, top]; steps at redshift 0 are left out. redshift: a column of step."""
    final = tree.filter(F.col("step") == last).select("gid", F.col("mass").alias("m0"))
    sample = F.array(*(F.struct(F.lit(k).alias("sample"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(samples)))
    psi = -F.log(F.col("mass") / F.col("m0")) / redshift
    rows = tree.join(final, "gid").filter(redshift > 0).withColumn("s", F.explode(sample)).filter("m0 >= s.a and m0 < s.b").withColumn("psi", psi).filter(F.col("psi").between(0, top))
    bin_ = F.least(F.floor(F.col("psi") * (bins / top) + 1e-9), F.lit(bins - 1)).cast("long")
    return histogram_quantiles(rows.select(F.col("s.sample").alias("sample"), "step", bin_.alias("bin")), ["sample", "step"], "bin", list(quantiles), least)


def tree_mass_function(tree: DataFrame, step: int, nbin: int) -> DataFrame:
    """Of the host masses of major lines at a step."""
    return mass_function(tree.filter((F.col("step") == step) & (F.col("gid") == F.col("majorgid"))), "fofhmass", nbin)


def orphan_mass_function(tree: DataFrame, step: int, nbin: int) -> DataFrame:
    """Of lines with a mass but no major line."""
    return mass_function(tree.filter((F.col("step") == step) & (F.col("mass") > 0) & (F.col("majorgid").isNull() | (F.col("majorgid") < 0))), "mass", nbin)


def transitions(tree: DataFrame, steps: list[int]) -> DataFrame:
    """(gid, switches): how often a line appears or disappears between the first and last step; three or more is an error."""
    lines = tree.select("gid").distinct().withColumn("step", F.explode(F.array(*(F.lit(s) for s in steps))))
    there = lines.join(tree.select("gid", "step", F.lit(1).alias("here")), ["gid", "step"], "left").withColumn("here", F.coalesce("here", F.lit(0)))
    w = Window.partitionBy("gid").orderBy("step")
    return there.withColumn("_s", F.coalesce((F.col("here") != F.lag("here").over(w)).cast("int"), F.lit(0))).groupBy("gid").agg(F.sum("_s").alias("switches"))


