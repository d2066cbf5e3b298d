"""Mass functions and other histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut


def reverse_cumulative(bins: DataFrame, value: str, order: str = "bin", by: list[str] | None = None) -> DataFrame:
    """Bins with `cumulative`, the sum of value over this and all later bins. bins: a row for each bin."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return bins.withColumn("cumulative", F.sum(value).over(w))


def mass_function(halos: DataFrame, mass: str, nbin: int, volume: float = 1.0, low: float | None = None, high: float | None = None, h: float = 1.0, top_edge: str = "keep") -> DataFrame:
    """(bin, n, mass, dndlogm, hi, lo, cumulative) over nbin bins of equal width in log10 mass.

    low, high: log10 of the range, else that of the halos. h multiplies masses. The heaviest halo is on the last bin's edge:
    `keep` counts it there, `drop` leaves it out; halos outside a given range are left out. Halos that are all alike get a range of one
    decade around them; no halos give no bins. Bins are means of their edges' masses; dndlogm is the number in a unit volume and decade,
    hi and lo one Poisson deviation off."""
    m = (F.col(mass) * h).cast("double")
    if low is not None and high is not None and high <= low:
        raise ValueError("high must be above low")
    rows = halos.filter(m > 0).select(F.log10(m).alias("logm"))
    if low is None or high is None:
        rows = cut(rows)  # the range and the counts read it: halos are found once
        least, most = rows.agg(F.min("logm"), F.max("logm")).first()
        if least is not None and (least if low is None else low) >= (most if high is None else high):
            least, most = (least - 0.5 if high is None else high - 1), (most + 0.5 if low is None else low + 1)
        low, high = (least if low is None else low), (most if high is None else high)
    if low is None or high is None:
        return halos.sparkSession.createDataFrame([], "bin long, n long, mass double, dndlogm double, hi double, lo double, cumulative double")
    width = (high - low) / nbin
    bin_ = F.floor((F.col("logm") - low) / width).cast("long")
    if top_edge == "keep":
        bin_ = F.when(F.col("logm") == F.lit(high), F.lit(nbin - 1).cast("long")).otherwise(bin_)
    counts = rows.filter(F.col("logm").between(low, high)).select(bin_.alias("bin")).filter(F.col("bin").between(0, nbin - 1)).groupBy("bin").agg(F.count("*").alias("n"))
    bins = halos.sparkSession.range(nbin).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    lo_m, hi_m = F.pow(F.lit(10.0), low + F.col("bin") * width), F.pow(F.lit(10.0), low + (F.col("bin") + 1) * width)
    mid = (lo_m + hi_m) * 0.5
    scale = mid * math.log(10.0) / (hi_m - lo_m) / volume
    out = bins.withColumn("mass", mid).withColumn("dndlogm", F.col("n") * scale).withColumn("hi", (F.col("n") + F.sqrt("n")) * scale).withColumn("lo", (F.col("n") - F.sqrt("n")) * scale)
    return reverse_cumulative(out, "n").withColumn("cumulative", F.col("cumulative") / volume)


def drop_group_head(subhalos: DataFrame, group: str, order: list) -> DataFrame:
    """all subhalos but the first of each group. order: columns, ascending, that tell the rows of a group apart."""
    key = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    heads = subhalos.groupBy(F.col(group).alias("_group")).agg(F.min(key).alias("_head"))
    return subhalos.withColumn("_key", key).join(heads, (F.col(group) == F.col("_group")) & (F.col("_key") == F.col("_head")), "left_anti").drop("_key")


def h_rescale(table: DataFrame, h: float) -> DataFrame:
    """A mass-function table (mass, value, hi, lo, cumulative) from units with h to units without."""
    return table.select((F.col("mass") / h).alias("mass"), *((F.col(c) * h**3).alias(c) for c in ("value", "hi", "lo", "cumulative")))


def hist2d(rows: DataFrame, x, y, xr: tuple[float, float], yr: tuple[float, float], n: int = 128) -> DataFrame:
    """(ix, iy, n) of the rows in the ranges."""
    ix = F.floor((x - xr[0]) / ((xr[1] - xr[0]) / n)).cast("long")
    iy = F.floor((y - yr[0]) / ((yr[1] - yr[0]) / n)).cast("long")
    return rows.select(ix.alias("ix"), iy.alias("iy")).filter(f"ix between 0 and {n - 1} and iy between 0 and {n - 1}").groupBy("ix", "iy").agg(F.count("*").alias("n"))


def histogram_quantiles(rows: DataFrame, by: list[str], bin_: str, quantiles: list[float], least: int) -> DataFrame:
    """For each group of at least `least` rows, the first bin at which the cumulative count exceeds each part."""
    counts = rows.groupBy(*by, bin_).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    cum = counts.withColumn("cum", F.sum("n").over(w.orderBy(bin_))).withColumn("total", F.sum("n").over(w)).filter(F.col("total") >= least)
    return cum.groupBy(*by).agg(F.max("total").alias("n"), *(F.min(F.when(F.col("cum") > q * F.col("total"), F.col(bin_))).alias(f"q{k}") for k, q in enumerate(quantiles)))
