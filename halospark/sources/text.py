"""Text sources and sinks: parameters, tables, halo lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameter names that are known (fixed values); others are read and marked.
KNOWN = ("OmegaMatter0", "OmegaLambda0", "OmegaBaryon0", "Hubble", "Boxsize(Mpc/h)", "Amax", "Astep", "Anow", "Nx", "Ny", "Nz", "Nspace", "Theta", "Stepnum", "Nskip", "Bias", "Powerflag")

#: The line that ends a header (a fixed value).
CLOSING = "#End of Ascii Header"


def read_params(spark: SparkSession, path: str, known=KNOWN) -> DataFrame:
    """(file, key, value, known) of lines `define KEY = VALUE`; lines that begin with # are comments.

    A file is read up to its closing line, if it has one: what follows, as a snapshot's records, is no header."""
    lines = spark.read.text(path).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).withColumn("_at", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()))
    end = lines.filter(F.rtrim("value") == CLOSING).groupBy("file").agg(F.min("_at").alias("_end"))
    lines = lines.join(end, "file", "left").filter(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    key, value = F.regexp_extract("value", r"^\s*define\s+(\S+)\s*=\s*(.*?)\s*$", 1), F.regexp_extract("value", r"^\s*define\s+(\S+)\s*=\s*(.*?)\s*$", 2)
    return lines.filter(~F.col("value").rlike(r"^\s*#")).select("file", key.alias("key"), value.alias("value")).filter("key <> ''").withColumn("known", F.col("key").isin(*known))


def params_map(params: DataFrame) -> DataFrame:
    """A row for each file with its parameters as a map; of repeated keys the last in order of value stays out, the largest is taken."""
    one = params.groupBy("file", "key").agg(F.max("value").alias("value"))
    return one.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("params"))


def read_table_ascii(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space separated numbers; lines that begin with # and empty ones are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")).filter("v <> '' and v not like '#%'")
    parts = F.split("v", " ")
    return lines.select(*(F.get(parts, F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)))


def export_halo_list(halos: DataFrame, path: str) -> None:
    """Mass, position and velocity as text."""
    halos.select("mass", "x", "y", "z", "vx", "vy", "vz").write.option("sep", " ").csv(path)


def assign_runs(members: DataFrame, halos: DataFrame, block: int = 100_000) -> DataFrame:
    """Members (row: their place in the file, from 0) with the hid of the run they are in; halos (hid, np) own the next np rows, in the order of hid.

    Prefix sums are taken in blocks of halos and over the blocks; a member meets the halos of a few cells of places, not all."""
    from pyspark.sql import Window

    blocks = halos.withColumn("_b", F.expr(f"hid div {block}"))
    sums = blocks.groupBy("_b").agg(F.sum("np").alias("_t")).withColumn("_before", F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).select("_b", "_before")  # a row for each block
    w = Window.partitionBy("_b").orderBy("hid")
    runs = blocks.join(F.broadcast(sums), "_b").withColumn("hi", F.col("_before") + F.sum("np").over(w)).withColumn("lo", F.col("hi") - F.col("np")).filter("np > 0")
    cell = 1024
    runs = runs.select("hid", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("_c"))
    return members.withColumn("_c", F.expr(f"row div {cell}")).join(runs, "_c").filter("row >= lo and row < hi").drop("_c", "lo", "hi")
