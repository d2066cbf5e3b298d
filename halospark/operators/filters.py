"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slab_filter(df: DataFrame, low, high) -> DataFrame:
    """low <= z < high, which Parquet statistics can skip files by."""
    return df.filter((F.col("z") >= low) & (F.col("z") < high))


def redshift_cut(df: DataFrame, z: Column, most: float) -> DataFrame:
    """F2."""
    return df.filter(z <= most)


def shell_zone(r2: Column, r1: int, r2_outer: int, maxd: int) -> Column:
    """main within [r1, r2), outer and inner in the buffers of width maxd around it, else null; of squared distances."""
    low = max(0, r1 - maxd)
    return F.when((r2 >= r1 * r1) & (r2 < r2_outer * r2_outer), "main").when((r2 >= r2_outer * r2_outer) & (r2 < (r2_outer + maxd) ** 2), "outer").when((r2 >= low * low) & (r2 < r1 * r1), "inner")


def min_members(df: DataFrame, group: str, least: int) -> DataFrame:
    """groups of at least `least` rows, with their counts."""
    return df.groupBy(group).agg(F.count("*").alias("np")).filter(F.col("np") >= least)


def mass_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """F6."""
    return df.filter((F.col("mass") >= low) & (F.col("mass") < high))


def optical_depth_cut(df: DataFrame, r: Column, dz: Column, tau: float) -> DataFrame:
    """in the front hemisphere and nearer than five optical depths."""
    return df.filter((dz > 0) & (r <= 5 * tau))


def drop_empty_histories(tree: DataFrame, gid: str = "gid", value: str = "mbp") -> DataFrame:
    """F8: rows of histories with a value at some step and a positive number."""
    seen = tree.filter(F.col(value).isNotNull() & (F.col(gid) >= 0)).select(gid).distinct()
    return tree.join(seen, gid, "left_semi")


def major_only(tree: DataFrame) -> DataFrame:
    """F9."""
    return tree.filter("gid = majorgid")
