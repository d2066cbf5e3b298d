"""Linking halos across steps by their most bound members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ALONE, MAJOR_LINE, MINOR_LINE, NEW_BORN, ONE_OF_MULTI
from ..scratch import cut

LINKS = ["step", "mbp", "nowhid", "mass", "fofhmass", "status", "lineflag", "prevhid", "prevmass"]


def was_mbp(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members that were a most bound member in the links."""
    return members.join(links.select(F.col("mbp").alias("indx")), "indx", "left_semi")


def missing_mbp(links: DataFrame, next_links: DataFrame) -> DataFrame:
    """Links whose MBP has none in the next step."""
    return links.join(next_links.select("mbp"), "mbp", "left_anti")


def attach_previous(links: DataFrame) -> DataFrame:
    """Links with the host and mass of the same MBP one step before."""
    before = links.select((F.col("step") + 1).alias("step"), "mbp", F.col("nowhid").alias("down_hid"), F.col("mass").alias("down_mass"))
    return links.drop("down_hid", "down_mass").join(before, ["step", "mbp"])


def attach_next(links: DataFrame) -> DataFrame:
    """Links with the host and line flag of the same MBP one step later, null where it is missing."""
    after = links.select((F.col("step") - 1).alias("step"), "mbp", F.col("nowhid").alias("up_hid"), F.col("lineflag").alias("up_line"))
    return links.join(after, ["step", "mbp"], "left")


def major_progenitor(candidates: DataFrame) -> DataFrame:
    """Candidates (hid, mbp, prevmass, ...) with rank and number in their halo; the heaviest, of equal ones the smallest mbp, is first."""
    by = Window.partitionBy("hid")
    return candidates.withColumn("rank", F.row_number().over(by.orderBy(F.desc("prevmass"), "mbp"))).withColumn("k", F.count("*").over(by))


def link_step(members: DataFrame, previous: DataFrame | None, step: int, least: int) -> DataFrame:
    """The links of one step, of its members (indx, hid, e) and the links of the step before.

    A halo of at least `least` members with no earlier MBP gets its own most bound member, NEW_BORN; with one, that is ALONE;
    with more, each is ONE_OF_MULTI, the heaviest on the major line with the halo's mass, the others on minor lines with the
    mass they had."""
    halos = members.groupBy("hid").agg(F.count("*").alias("np"), F.min(F.struct("e", "indx")).alias("own")).filter(F.col("np") >= least).select("hid", "np", F.col("own.indx").alias("own"))
    born = halos.select(F.lit(step).alias("step"), F.col("own").alias("mbp"), F.col("hid").alias("nowhid"), F.col("np").alias("mass"), F.col("np").alias("fofhmass"), F.lit(NEW_BORN).alias("status"), F.lit(0).alias("lineflag"), F.lit(None).cast("long").alias("prevhid"), F.lit(None).cast("long").alias("prevmass"))
    if previous is None:
        return born
    before = previous.select(F.col("mbp"), F.col("nowhid").alias("prevhid"), F.col("mass").alias("prevmass"))
    up = members.join(halos, "hid").select("hid", "np", F.col("indx").alias("mbp")).join(before, "mbp")
    ranked = major_progenitor(up)
    linked = ranked.select(
        F.lit(step).alias("step"), "mbp", F.col("hid").alias("nowhid"), F.when(F.col("rank") == 1, F.col("np")).otherwise(F.col("prevmass")).alias("mass"), F.col("np").alias("fofhmass"),
        F.when(F.col("k") == 1, ALONE).otherwise(ONE_OF_MULTI).alias("status"), F.when(F.col("k") == 1, 0).when(F.col("rank") == 1, MAJOR_LINE).otherwise(MINOR_LINE).alias("lineflag"), "prevhid", "prevmass",
    )
    return linked.unionByName(born.join(up.select(F.col("hid").alias("nowhid")), "nowhid", "left_anti"))


def link_steps(members: DataFrame, steps: list[int], least: int) -> DataFrame:
    """T1 over all steps (step, indx, hid, e). A step's new MBPs are candidates at the next, so steps are taken in order; each is written, which ends its lineage."""
    out, links = None, None
    for s in steps:
        links = cut(link_step(members.filter(F.col("step") == s).drop("step"), links, s, least).select(*LINKS))
        out = links if out is None else out.unionByName(links)
    return out


def trace(links: DataFrame, start: DataFrame, down: bool, steps: int) -> DataFrame:
    """Rows of links reached from start (step, mbp) by going down or up one step at a time, as long as the MBP is there.

    Each round is a join of the frontier, which is written, so no round is evaluated twice."""
    d = -1 if down else 1
    frontier = cut(links.join(start.select("step", "mbp").distinct(), ["step", "mbp"], "left_semi"))
    out = frontier
    for _ in range(1, steps):
        frontier = cut(links.join(frontier.select((F.col("step") + d).alias("step"), "mbp"), ["step", "mbp"], "left_semi"))
        out = out.unionByName(frontier)
    return out
