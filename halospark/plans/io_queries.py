"""Queries for sources, sinks and streams: data derived from the tables is written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as L
from ..operators.lookups import snapshot_schedule
from ..operators.tree import build_tree, histories
from ..scratch import cut, shared_dir
from ..sources import binary as B
from ..sources import tables, text
from ..streaming import products
from .base import TREE, links_sql, query, tsc_sql
from .fixtures import CLUMPS, HALO_PROPS, MEMBERS, MESH, MIN_MEMBERS, PARTICLES, STEPS, clumps, halo_props, members, particles
from .mesh_queries import tsc


def _floats(df, *names):
    return [F.col(n).cast("double").alias(n) for n in names]


@query(f"SELECT indx, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(vx AS DOUBLE) AS vx, CAST(vy AS DOUBLE) AS vy, CAST(vz AS DOUBLE) AS vz FROM ({PARTICLES})")
def s1_read_snapshot(spark, sf):
    path = shared_dir(spark)
    B.write_records(particles(spark, sf).repartitionByRange(4, "z"), path, B.SNAPSHOT, "ascii", {"Nx": 16384, "Boxsize(Mpc/h)": 1024})
    rows = B.read_records(spark, path, B.SNAPSHOT, "ascii", 5000)
    return rows.select("indx", *_floats(rows, "x", "y", "z", "vx", "vy", "vz"))


@query("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value, n_name IN ('Hubble') AS known FROM (SELECT replace(n_name, ' ', '_') AS n_name, n_nationkey FROM nation)")
def s2_read_params(spark, sf):
    path = shared_dir(spark)
    lines = spark.read.parquet(f"{sf}/nation.parquet").select(F.explode(F.array(F.concat(F.lit("# comment = "), "n_name"), F.concat(F.lit("define "), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" = "), F.col("n_nationkey").cast("string")))).alias("value"))
    lines.write.text(path)
    return text.read_params(spark, path).select("key", "value", "known")


@query(f"SELECT np, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(vx AS FLOAT) AS DOUBLE) AS vx FROM (SELECT CAST(count(*) AS BIGINT) AS np, avg(x) AS x, avg(vx) AS vx FROM ({CLUMPS}) GROUP BY hid)")
def s3_read_halo_catalog(spark, sf):
    path = shared_dir(spark)
    cat = clumps(spark, sf).groupBy("hid").agg(F.count("*").alias("np"), *(F.avg(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    B.write_records(cat.repartition(3, "hid"), path, B.HALO, B.HALO_HEADER, {"size": 1024, "nx": 16384})
    rows = B.read_records(spark, path, B.HALO, B.HALO_HEADER)
    return rows.select("np", *_floats(rows, "x", "vx"))


@query(f"SELECT step, indx, hid FROM ({MEMBERS})")
def s4_read_members(spark, sf):
    """For each step a member file in halo order, without halo numbers; the halos' numbers and counts say whose its rows are."""
    from ..operators.fof import dense_numbers

    path, rows, out = shared_dir(spark), cut(members(spark, sf)), None
    for s in range(STEPS):
        mine = rows.filter(F.col("step") == s)
        dense_numbers(mine.select("indx", "hid"), [F.col("hid"), F.col("indx")], "row").select("row", "indx").write.parquet(f"{path}/{s}")
        runs = text.assign_runs(spark.read.parquet(f"{path}/{s}"), mine.groupBy("hid").agg(F.count("*").alias("np")), 100).select(F.lit(s).alias("step"), "indx", "hid")
        out = runs if out is None else out.unionByName(runs)
    return out


@query(f"SELECT hid, CAST(CAST(mass AS FLOAT) AS DOUBLE) AS mass, CAST(CAST(q AS FLOAT) AS DOUBLE) AS q, CAST(CAST(s AS FLOAT) AS DOUBLE) AS s, CAST(3*mass AS DOUBLE) AS ang_sum FROM ({HALO_PROPS})")
def s5_read_halo_props(spark, sf):
    path = shared_dir(spark)
    zero = {c: F.lit(0.0) for c in ("x", "y", "z", "vx", "vy", "vz", "paraspin", "sigv", "rotation", "radius", "kw")}
    props = halo_props(spark, sf).withColumns(zero | {"mbp": F.col("hid"), "ang_mom": F.array(*[F.col("mass").cast("double")] * 3), "axes": F.array(*[F.lit(0.0)] * 9)})
    B.write_records(props.repartition(2, "hid"), path, B.HALO_PROP)
    rows = B.read_records(spark, path, B.HALO_PROP, "none", 100)
    total = F.aggregate("ang_mom", F.lit(0.0), lambda a, x: a + x)
    return rows.select("hid", *_floats(rows, "mass", "q", "s"), total.alias("ang_sum"))


@query(f"WITH {TREE} SELECT step, gid, mbp, CAST(mass AS DOUBLE) AS mass FROM tree")
def s6_read_tree(spark, sf):
    """A record for each line with arrays over the steps, 0 where it is absent; read back in long form."""
    path = shared_dir(spark)
    layout = B.TREE.format(n=STEPS)
    t = build_tree(L.link_steps(members(spark, sf), list(range(STEPS)), MIN_MEMBERS))
    at = lambda c: F.array(*(F.coalesce(F.max(F.when(F.col("step") == s, F.col(c))), F.lit(0)) for s in range(STEPS)))
    B.write_records(t.groupBy("gid").agg(at("mbp").alias("mbp"), at("nowhid").alias("nowhid"), at("mass").cast("array<double>").alias("mass")), path, layout)
    rows = B.read_records(spark, path, layout)
    return rows.select("gid", F.posexplode(F.arrays_zip("mbp", "mass")).alias("step", "r")).filter("r.mbp > 0").select("step", "gid", F.col("r.mbp").alias("mbp"), F.col("r.mass").cast("double").alias("mass"))


@query("SELECT CAST(p_size AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS pk FROM part GROUP BY 1")
def s7_read_table_ascii(spark, sf):
    path = shared_dir(spark)
    counts = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_size").agg(F.count("*").alias("n"))
    counts.select(F.explode(F.array(F.lit("# k  P(k)"), F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit("\t "), F.col("n").cast("string")))).alias("value")).write.text(path)
    return text.read_table_ascii(spark, path, ["k", "pk"])


@query(f"SELECT indx, x, y, z FROM ({PARTICLES})")
def s8_write_snapshot(spark, sf):
    path = shared_dir(spark)
    tables.write_snapshot(particles(spark, sf).withColumn("step", F.lit(1)), path)
    return spark.read.parquet(path).filter("step = 1").select("indx", "x", "y", "z")


@query(f"SELECT step, hid, CAST(count(*) AS BIGINT) AS np FROM ({MEMBERS}) GROUP BY 1, 2 HAVING count(*) >= 20")
def s9_write_halos(spark, sf):
    path, rows = shared_dir(spark), members(spark, sf)
    tables.write_halos(rows.groupBy("step", "hid").agg(F.count("*").alias("np")), rows, path)
    return spark.read.parquet(f"{path}/members").groupBy("step", "hid").agg(F.count("*").alias("np"))


@query(f"SELECT CAST(count(*) AS DOUBLE) AS mass, CAST(sum(x) AS DOUBLE) AS x FROM ({CLUMPS}) GROUP BY hid")
def s10_export_halo_list(spark, sf):
    path = shared_dir(spark)
    cat = clumps(spark, sf).groupBy("hid").agg(F.count("*").alias("mass"), *(F.sum(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    text.export_halo_list(cat, path)
    return text.read_table_ascii(spark, path, ["mass", "x", "y", "z", "vx", "vy", "vz"]).select("mass", "x")


@query(f"WITH p AS MATERIALIZED ({PARTICLES}), {tsc_sql(MESH, 16)} SELECT ix, iy, iz, value FROM g")
def s11_write_density(spark, sf):
    path = shared_dir(spark)
    tables.write_density(tsc(spark, sf).withColumn("step", F.lit(0)), path)
    return spark.read.parquet(path).filter("step = 0").select("ix", "iy", "iz", "value")


@query(f"WITH {TREE} SELECT step, gid, mbp, mass FROM tree")
def s12_write_tree_step(spark, sf):
    path = shared_dir(spark)
    tables.write_tree(build_tree(L.link_steps(members(spark, sf), list(range(STEPS)), MIN_MEMBERS)), path)
    return spark.read.parquet(path).select("step", "gid", "mbp", "mass")


@query(f"WITH {TREE} SELECT gid, CAST(count(*) AS INTEGER) AS n, min(step) AS birth, max(step) AS last, CAST(sum(mass) AS BIGINT) AS mass FROM tree GROUP BY 1")
def s13_merge_tree_steps(spark, sf):
    path = shared_dir(spark)
    tables.write_tree(build_tree(L.link_steps(members(spark, sf), list(range(STEPS)), MIN_MEMBERS)), path)
    steps = [spark.read.parquet(f"{path}/step={s}").withColumn("step", F.lit(s)) for s in range(STEPS)]
    whole = steps[0]
    for s in steps[1:]:
        whole = whole.unionByName(s)
    h = histories(whole, ["mbp", "mass"])
    return h.select("gid", F.size("history").alias("n"), F.col("history")[0]["step"].alias("birth"), F.element_at("history", -1)["step"].alias("last"), F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x["mass"]).alias("mass"))


@query(f"SELECT CAST(indx % 4 AS INTEGER) AS iobs, CASE WHEN indx % 3 = 0 THEN 'main' ELSE 'outer' END AS type, CAST(count(*) AS BIGINT) AS n FROM ({PARTICLES}) GROUP BY 1, 2")
def s14_write_cone(spark, sf):
    from ..operators.cone import write_cone

    path = shared_dir(spark)
    rows = particles(spark, sf).select("indx", "x", (F.col("indx") % 4).cast("int").alias("iobs"), F.when(F.col("indx") % 3 == 0, "main").otherwise("outer").alias("type"), F.lit(5).alias("step"))
    write_cone(rows, path)
    return spark.read.parquet(path).groupBy("iobs", "type").agg(F.count("*").alias("n"))


def _arrive(spark, rows, path):
    """Writes rows a step at a time, as they would arrive, each step in several files."""
    rows = cut(rows)
    for s in range(STEPS):
        rows.filter(F.col("step") == s).repartition(FILES, "indx").write.mode("append").parquet(path)
    return rows.schema


#: Files that a step arrives in, and files of a batch, so that steps span batches.
FILES, BATCH = 3, 4


@query(f"SELECT step, hid, CAST(count(*) AS BIGINT) AS np FROM ({MEMBERS}) WHERE step IN (0, 2, 4) GROUP BY 1, 2")
def r1_stream_products(spark, sf):
    path, out = shared_dir(spark), shared_dir(spark)
    schema = _arrive(spark, members(spark, sf), path)
    times = spark.range(STEPS).select(F.col("id").cast("int").alias("step"), ((F.col("id") + 2) / 10).alias("a"))
    due = snapshot_schedule(times, [4.0, 1.5, 2 / 3], 1.0, 0.1)  # the redshifts of steps 0, 2 and 4
    products.stream_products(products.arriving(spark, path, schema, BATCH), out, shared_dir(spark), shared_dir(spark), due, lambda b: b.groupBy("step", "hid").agg(F.count("*").alias("np")))
    return spark.read.parquet(out).select("step", "hid", "np")


@query(f"SELECT step, hid, CAST(count(*) AS BIGINT) AS np, CAST(sum(e) AS BIGINT) AS total, CAST(min(e) AS BIGINT) AS least FROM ({MEMBERS}) WHERE step IN (0, 2, 4) GROUP BY 1, 2")
def r1_stream_totals(spark, sf):
    """The same steps from state that is kept between batches."""
    path, out = shared_dir(spark), shared_dir(spark)
    schema = _arrive(spark, members(spark, sf), path)
    due = spark.createDataFrame([(0,), (2,), (4,)], "step int")
    products.stream_totals(products.arriving(spark, path, schema, BATCH), out, shared_dir(spark), due, ["hid"], {"np": F.count("*"), "total": F.sum("e"), "least": F.min("e")})
    return products.latest(spark, out, ["hid"]).select("step", "hid", "np", "total", "least")


@query(f"WITH m AS ({MEMBERS}) SELECT a.indx, a.step, round(0.9e0*a.e + 0.6e0*(b.e - 0.8e0*a.e), 6) AS v FROM m a JOIN m b ON b.indx = a.indx AND b.step = a.step + 1")
def r2_stream_cone_sync(spark, sf):
    path, out = shared_dir(spark), shared_dir(spark)
    timed = members(spark, sf).select("indx", "step", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step") * 600).alias("ts"), F.col("e").cast("double").alias("v"))
    schema = _arrive(spark, timed, path)
    a = products.arriving(spark, path, schema, FILES * STEPS).withColumnRenamed("v", "v0")
    b = products.arriving(spark, path, schema, FILES * STEPS).withColumnRenamed("v", "v1")
    products.stream_cone_sync(a, b, out, shared_dir(spark), shared_dir(spark), 0.9, 0.6, 0.8)
    return spark.read.schema("indx long, step int, v double").parquet(out).select("indx", "step", F.round("v", 6).alias("v"))


@query(f"WITH {links_sql()} SELECT {', '.join(L.LINKS)} FROM links")
def r3_stream_link(spark, sf):
    path, out = shared_dir(spark), shared_dir(spark)
    schema = _arrive(spark, members(spark, sf), path)
    products.stream_links(products.arriving(spark, path, schema, BATCH), out, shared_dir(spark), shared_dir(spark), MIN_MEMBERS)
    return spark.read.parquet(out).select(*L.LINKS)
