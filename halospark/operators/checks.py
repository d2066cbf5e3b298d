"""Validation queries: violations and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def missing_link_fraction(links: DataFrame, next_links: DataFrame, bins_per_decade: int = 4) -> DataFrame:
    """V1: by bin of log mass, how many links there are and how many have no next."""
    has = next_links.select("mbp", F.lit(1).alias("_n")).distinct()
    bin_ = F.floor(F.log10("mass") * bins_per_decade + 1e-9).cast("long")
    return links.join(has, "mbp", "left").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("_n").isNull()).alias("missing"))


def duplicate_hosts(links: DataFrame) -> DataFrame:
    """V2: hosts with more than one link that has the host's mass."""
    return links.filter("mass = fofhmass").groupBy("step", "nowhid").agg(F.count("*").alias("n")).filter("n > 1")


def low_final_mass(tree: DataFrame, last: int, least: float) -> DataFrame:
    """V3."""
    return tree.filter(F.col("step") == last).agg(F.count("*").alias("n"), F.count_if(F.col("mass") < least).alias("low"))


def null_mbp(tree: DataFrame, lines: DataFrame, steps: list[int]) -> DataFrame:
    """V4: by step, how many of the lines have no MBP."""
    there = tree.groupBy("step").agg(F.count("mbp").alias("n"))
    total = lines.agg(F.count("*").alias("lines"))
    all_steps = tree.sparkSession.range(len(steps)).select(F.array(*(F.lit(s) for s in steps))[F.col("id").cast("int")].alias("step"))
    return all_steps.join(there, "step", "left").join(F.broadcast(total)).select("step", "lines", (F.col("lines") - F.coalesce("n", F.lit(0))).alias("nulls"))


def changing_mbp(tree: DataFrame) -> DataFrame:
    """V5: lines with more than one MBP."""
    return tree.groupBy("gid").agg(F.count_distinct("mbp").alias("n")).filter("n > 1")


def history_gaps(tree: DataFrame) -> DataFrame:
    """V6: lines that vanish and come back, with the number of gaps."""
    w = Window.partitionBy("gid").orderBy("step")
    return tree.withColumn("_gap", (F.col("step") - F.lag("step").over(w) > 1).cast("int")).groupBy("gid").agg(F.sum("_gap").alias("gaps")).filter("gaps > 0")


def vanished(tree: DataFrame, last: int) -> DataFrame:
    """V6: by their last step, how many lines vanish before the end."""
    return tree.groupBy("gid").agg(F.max("step").alias("step")).filter(F.col("step") < last).groupBy("step").agg(F.count("*").alias("n"))


def birth_not_major(tree: DataFrame) -> DataFrame:
    """V7: lines whose first major line isn't themselves."""
    first = tree.filter("majorgid is not null").groupBy("gid").agg(F.min(F.struct("step", "majorgid")).alias("f"))
    return first.select("gid", F.col("f.step").alias("step"), F.col("f.majorgid").alias("majorgid")).filter("gid <> majorgid")


def row_conservation(df: DataFrame, key: str, path: str, partitions: int | None = None) -> DataFrame:
    """V8: counts and sums of a key before and after rows are exchanged by it, observed on the way while they are written to path: df is read once."""
    before, after = Observation(), Observation()
    metrics = lambda: (F.count(F.lit(1)).alias("n"), F.sum(key).alias("total"))
    rows = df.observe(before, *metrics())
    rows = rows.repartition(key) if partitions is None else rows.repartition(partitions, key)
    rows.observe(after, *metrics()).write.parquet(path)
    seen = [(side, o.get["n"], o.get["total"]) for side, o in (("before", before), ("after", after))]
    return df.sparkSession.createDataFrame(seen, "side string, n long, total long")
