"""Stand-ins for snapshots and catalogues, derived from the driver's tables, in Spark and in SQL with the same expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX, LINK, CELLS = 16384, 40, 256
#: Members that make a halo in the particle box, and in the step tables.
MIN_NP, MIN_MEMBERS = 20, 16
STEPS = 5
MESH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _axis(field: int, near: int, spread: int) -> str:
    return (
        f"CASE WHEN indx%10=0 THEN CAST(floor(((indx*{field})%131072)/8) AS BIGINT) "
        f"ELSE (pk*{near} + CAST(floor(((indx*{spread})%8192)/64) AS BIGINT) - 64 + 16384) % 16384 END"
    )


PARTICLE_COLUMNS = [
    "indx", _axis(40503, 7919, 2654435761) + " AS x", _axis(69069, 104729, 2246822519) + " AS y", _axis(48271, 1299709, 3266489917) + " AS z",
    "(indx*7351)%2001-1000 AS vx", "(indx*9973)%2001-1000 AS vy", "(indx*12289)%2001-1000 AS vz",
]
PARTICLES = f"SELECT {', '.join(PARTICLE_COLUMNS)} FROM (SELECT l_orderkey*64+l_linenumber AS indx, min(l_partkey) AS pk FROM lineitem GROUP BY 1) q"


#: As PARTICLE_COLUMNS, with factors reduced before they are multiplied, which leaves the same remainders: at 360 times sf0.1 indx*3266489917 passes 2^63.
_REDUCED = [re.sub(r"\(indx\*(\d+)\)%(\d+)", r"((indx%\2)*\1)%\2", c) for c in PARTICLE_COLUMNS]


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in a periodic box of BOX units: a clump around each part, and a tenth of the particles anywhere."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey*64+l_linenumber").alias("indx")).agg(F.min("l_partkey").alias("pk"))
    return rows.selectExpr(*_REDUCED)


_STEPS = " UNION ALL ".join(f"SELECT {s} AS s" for s in range(STEPS))
MEMBERS = f"""SELECT s AS step, o_orderkey AS indx, hid, e FROM (
 SELECT s, o_orderkey, CAST(floor(o_custkey/pow(2,s+1)) AS BIGINT) AS hid, (o_orderkey*7351+s*977)%100003 AS e
 FROM orders CROSS JOIN ({_STEPS}) t WHERE (o_orderkey*31+s*17)%16 <> 0) q"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halo members over STEPS steps: halos merge in pairs, and a sixteenth of the members drop out at each. e: total energy."""
    rows = table(spark, sf_dir, "orders").withColumn("s", F.explode(F.array(*(F.lit(s) for s in range(STEPS)))))
    rows = rows.filter("(o_orderkey*31+s*17)%16 <> 0")
    return rows.selectExpr("s AS step", "o_orderkey AS indx", "CAST(floor(o_custkey/pow(2,s+1)) AS BIGINT) AS hid", "(o_orderkey*7351+s*977)%100003 AS e")


#: Every particle with a group: the clumps that share a part, which need no linking; hid is the part.
CLUMPS = f"SELECT pk AS hid, {', '.join(PARTICLE_COLUMNS)} FROM (SELECT l_orderkey*64+l_linenumber AS indx, min(l_partkey) AS pk FROM lineitem GROUP BY 1) q"


def clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey*64+l_linenumber").alias("indx")).agg(F.min("l_partkey").alias("pk"))
    return rows.selectExpr("pk AS hid", *_REDUCED)


#: Steps of a run with their scale factor: as many as there are days with orders, numbered in order.
RUN_STEPS = "SELECT step, 1 + 0.25e0*(step-1) AS a FROM (SELECT DISTINCT (o_orderkey % 189) + 1 AS step FROM orders) q"
AMAX = 48


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey % 189 + 1 AS step").distinct().selectExpr("step", "1 + 0.25D*(step-1) AS a")


#: Halo properties: mass and axis ratios by customer.
HALO_PROPS = "SELECT c_custkey AS hid, c_nationkey AS host, CAST(floor(c_acctbal) AS BIGINT) + 1000 AS mass, (1 + (c_custkey*31) % 96) / 97e0 AS q, (1 + (c_custkey*17) % 96) / 97e0 AS s FROM customer"


def halo_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS hid", "c_nationkey AS host", "CAST(floor(c_acctbal) AS BIGINT) + 1000 AS mass", "(1 + (c_custkey*31) % 96) / 97D AS q", "(1 + (c_custkey*17) % 96) / 97D AS s")


OBSERVERS = f"SELECT (i*4+j)*4+k AS iobs, i*{BOX // 4}+{BOX // 8} AS ox, j*{BOX // 4}+{BOX // 8} AS oy, k*{BOX // 4}+{BOX // 8} AS oz FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j), (SELECT unnest(range(4)) AS k)"
SHELL = (1000, 1800, 40)


#: A run of five snapshots, in which particles move by a fiftieth of their velocity a step, and its steps.
RUN_FIRST, RUN_LENGTH = 44, 5
DRIFT = f"SELECT CAST(s AS BIGINT) AS step, indx, {', '.join(f'((({c} + s*CAST(trunc(v{c}/50e0) AS BIGINT)) % {BOX}) + {BOX}) % {BOX} AS {c}' for c in 'xyz')}, vx, vy, vz FROM ({PARTICLES}) p, (SELECT unnest(range({RUN_LENGTH})) AS s) t"
DRIFT_STEPS = f"SELECT CAST(s AS BIGINT) AS step, {RUN_FIRST}e0 + s AS a FROM (SELECT unnest(range({RUN_LENGTH})) AS s) t"


def drift(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The run of all particles, or of the given ones."""
    rows = (particles(spark, sf_dir) if rows is None else rows).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RUN_LENGTH - 1).cast("long"))))
    return rows.select("step", "indx", *(F.expr(f"pmod({c} + step * (v{c} div 50), {BOX})").alias(c) for c in "xyz"), "vx", "vy", "vz")


def drift_steps(spark: SparkSession) -> DataFrame:
    return spark.range(RUN_LENGTH).select(F.col("id").alias("step"), (F.lit(float(RUN_FIRST)) + F.col("id")).alias("a"))
