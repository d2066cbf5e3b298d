"""Nearest, interval and ordered lookups; partitioning by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .fof import RANGE_ROWS


def snapshot_schedule(steps: DataFrame, wanted: list[float], amax: float, astep: float) -> DataFrame:
    """Steps (step, a) at least as near to one of the wanted redshifts as the steps before and after."""
    z, before, after = amax / F.col("a") - 1, amax / (F.col("a") - astep) - 1, amax / (F.col("a") + astep) - 1
    near = F.exists(F.array(*(F.lit(float(w)) for w in wanted)), lambda w: (F.abs(z - w) <= F.abs(before - w)) & (F.abs(z - w) <= F.abs(after - w)))
    return steps.filter((F.col("a") > astep) & near).select("step", z.alias("z"))


def lookup_linear(rows: DataFrame, x: str, knots: DataFrame, name: str = "y") -> DataFrame:
    """Rows with the value at x of the line through the knots (kx, ky; a short table), held at the last knot's value beyond it and null below the first."""
    w = Window.orderBy("kx")
    spans = knots.select("kx", "ky", F.lead("kx").over(w).alias("nx"), F.lead("ky").over(w).alias("ny"))
    found = rows.join(F.broadcast(spans), (F.col(x) >= F.col("kx")) & (F.col("nx").isNull() | (F.col(x) < F.col("nx"))), "left")
    value = F.when(F.col("nx").isNull(), F.col("ky")).otherwise(F.col("ky") + (F.col("ny") - F.col("ky")) * (F.col(x) - F.col("kx")) / (F.col("nx") - F.col("kx")))
    return found.withColumn(name, value).drop("kx", "ky", "nx", "ny")


def equal_count_bounds(df: DataFrame, col: str, parts: int, low: float, high: float, bins: int = 1000) -> DataFrame:
    """(part, bound): where the k-th of `parts` equal counts ends, from a histogram of `bins` bins, linear inside a bin."""
    width = (high - low) / bins
    counts = df.groupBy(F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")  # a row for each bin
    cum = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    goals = cum.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))) if parts > 1 else cum.limit(0).withColumn("part", F.lit(1))
    goal = F.col("part") * F.col("total") / parts
    hit = goals.filter((F.col("upto") >= goal) & (F.col("upto") - F.col("n") < goal))
    return hit.select("part", (low + width * (F.col("bin") + (goal - (F.col("upto") - F.col("n"))) / F.col("n"))).alias("bound"))


def load_imbalance(df: DataFrame, by=None) -> DataFrame:
    """(avg - min)/avg and (max - avg)/avg of the row counts of tasks, or of another column."""
    counts = df.groupBy((F.spark_partition_id() if by is None else by).alias("_p")).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("parts"), F.avg("n").alias("mean"), ((F.avg("n") - F.min("n")) / F.avg("n")).alias("below"), ((F.max("n") - F.avg("n")) / F.avg("n")).alias("above"))


def repartition_slabs(df: DataFrame, parts: int, col: str = "z") -> tuple[DataFrame, DataFrame]:
    """O3: df in `parts` ranges of about equal counts, and their bounds."""
    ranged = cut(df.repartitionByRange(parts, col).withColumn("slab", F.spark_partition_id()))
    return ranged, ranged.groupBy("slab").agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count("*").alias("n"))


def ranges_of(df: DataFrame, rows: int = RANGE_ROWS) -> int:
    """The number of ranges of about `rows` rows that df needs."""
    return max(1, -(-df.count() // rows))


def sort_by_key(df: DataFrame, *order, parts: int | None = None) -> DataFrame:
    """O1: df in `parts` ranges of the order, as many as its rows need by default, each sorted: partition after partition, rows are in order."""
    if parts is None:
        df = cut(df)
        parts = ranges_of(df)
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """O4, A34."""
    return df.orderBy(*order).limit(n)


#: Distinct values of a group that are put in order in one task at most, and the parts in which a histogram cuts a range.
FEW, PARTS = 100_000, 1024


def value_at_rank(rows: DataFrame, group: str, value: str, part: float, few: int = FEW) -> DataFrame:
    """(group, value): of each group the value of rank ceil(part * rows), from the least on; null values don't count.

    Equal values are counted first. A group with over `few` different ones is narrowed down: a histogram of PARTS parts of its range tells in
    which part the rank is, and only that part's values go on. So no task has a group's rows."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = cut(counts)
    goals = counts.groupBy("g").agg(F.ceil(part * F.sum("n")).alias("rank"))
    now, out = counts.join(goals, "g"), None
    while True:
        ranges = cut(now.groupBy("g").agg(F.count("*").alias("many"), F.min("v").alias("low"), F.max("v").alias("high")))
        over = ranges.filter((F.col("many") > few) & (F.col("low") < F.col("high")))
        done = now if over.isEmpty() else now.join(over, "g", "left_anti")
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("v"))  # `few` values at most
        found = done.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("g", "v")
        out = found if out is None else out.unionByName(found)
        if over.isEmpty():
            return out.select(F.col("g").alias(group), F.col("v").alias(value))
        place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1)).cast("int")
        placed = cut(now.join(over, "g").withColumn("p", place))
        bins = placed.groupBy("g", "p", "rank").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("p")))
        hit = bins.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("g", "p", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rest"))
        now = cut(placed.join(hit, ["g", "p"]).select("g", "v", "n", F.col("rest").alias("rank")))
