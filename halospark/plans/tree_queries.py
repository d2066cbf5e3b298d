"""Queries for links, merger trees and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..operators import links as L
from ..operators import tree as T
from ..operators.fof import numbered
from ..scratch import cut, shared_dir
from .base import TREE, TREE_COLUMNS, links_sql, query
from .fixtures import MIN_MEMBERS, STEPS, members
from .halo_queries import MF
from .mesh_queries import _rounded

LAST = STEPS - 1
LINK_COLUMNS = ", ".join(L.LINKS)


def links(spark, sf):
    return L.link_steps(members(spark, sf), list(range(STEPS)), MIN_MEMBERS)


def tree(spark, sf):
    return cut(T.build_tree(links(spark, sf)))


@query(f"WITH {links_sql()} SELECT {LINK_COLUMNS} FROM links")
def t1_link_steps(spark, sf):
    return links(spark, sf)


@query(f"WITH {TREE} SELECT {TREE_COLUMNS} FROM tree")
def t2_build_tree(spark, sf):
    return tree(spark, sf).select(*TREE_COLUMNS.split(", "))


@query(f"WITH {links_sql()} SELECT m.step, m.indx, m.hid, m.e FROM m JOIN links ON m.indx = links.mbp AND m.step = links.step + 1")
def j5_was_mbp(spark, sf):
    rows, all_links = members(spark, sf), cut(links(spark, sf))
    return _union([L.was_mbp(rows.filter(F.col("step") == s + 1), all_links.filter(F.col("step") == s)).select("step", "indx", "hid", "e") for s in range(LAST)])


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {links_sql()} SELECT a.step, a.mbp, a.nowhid FROM links a WHERE a.step < {LAST} AND NOT EXISTS (SELECT 1 FROM links b WHERE b.step = a.step + 1 AND b.mbp = a.mbp)")
def j6_missing_mbp(spark, sf):
    all_links = cut(links(spark, sf))
    return _union([L.missing_mbp(all_links.filter(F.col("step") == s), all_links.filter(F.col("step") == s + 1)) for s in range(LAST)]).select("step", "mbp", "nowhid")


@query(f"WITH {links_sql()} SELECT a.step, a.mbp, b.nowhid AS down_hid, b.mass AS down_mass FROM links a JOIN links b ON b.step = a.step - 1 AND b.mbp = a.mbp")
def j7_attach_previous(spark, sf):
    return L.attach_previous(links(spark, sf)).select("step", "mbp", "down_hid", "down_mass")


@query(f"WITH {links_sql()} SELECT a.step, a.mbp, b.nowhid AS up_hid, b.lineflag AS up_line FROM links a LEFT JOIN links b ON b.step = a.step + 1 AND b.mbp = a.mbp")
def j8_attach_next(spark, sf):
    return L.attach_next(links(spark, sf)).select("step", "mbp", "up_hid", "up_line")


@query(f"WITH {TREE} SELECT a.step, a.mbp, a.gid, b.gid AS gid_before FROM tree a JOIN tree b ON b.step = a.step - 1 AND b.mbp = a.mbp")
def j9_propagate_gid(spark, sf):
    return T.propagate_gid(tree(spark, sf))


_SIG = "sg AS (SELECT step, hid, CAST(max(e) - min(e) AS BIGINT) AS sigv FROM m GROUP BY 1, 2)"


@query(f"WITH {TREE}, {_SIG} SELECT t.step, t.gid, s.sigv FROM tree t LEFT JOIN sg s ON s.step = t.step AND s.hid = t.nowhid")
def j10_attach_halo_quantity(spark, sf):
    q = members(spark, sf).groupBy("step", "hid").agg((F.max("e") - F.min("e")).alias("sigv"))
    return T.attach_quantity(tree(spark, sf), q).select("step", "gid", "sigv")


SORTED = f"""{TREE}, ln AS (SELECT gid, row_number() OVER (ORDER BY coalesce(mj, 4611686018427387904), gid) - 1 AS newgid FROM (SELECT gid, max(CASE WHEN step = {LAST} THEN majorgid END) AS mj FROM tree GROUP BY 1)),
st AS MATERIALIZED (SELECT t.* EXCLUDE (gid, majorgid), a.newgid AS gid, b.newgid AS majorgid FROM tree t JOIN ln a ON a.gid = t.gid JOIN ln b ON b.gid = t.majorgid)"""


@query(f"WITH {SORTED} SELECT step, mbp, majorgid FROM st")
def j11_relabel_gid(spark, sf):
    return T.sort_by_major(tree(spark, sf), LAST).select("step", "mbp", "majorgid")


@query(f"WITH {links_sql(1)} SELECT h.step, h.hid, h.np, CAST(s.e AS BIGINT) AS e FROM h JOIN (SELECT step, hid, sum(e) AS e FROM m GROUP BY 1, 2) s USING (step, hid)")
def j12_zip_halo_props(spark, sf):
    rows = members(spark, sf)
    catalog = rows.groupBy("step", "hid").agg(F.count("*").alias("np")).filter(F.col("np") >= MIN_MEMBERS)
    return catalog.join(rows.groupBy("step", "hid").agg(F.sum("e").alias("e")), ["step", "hid"])


@query(f"WITH {TREE} SELECT t.step, t.gid, a.e AS x, CAST(b.hx AS BIGINT) AS hx FROM tree t LEFT JOIN m a ON a.step = t.step AND a.indx = t.mbp LEFT JOIN (SELECT step, hid, sum(e) AS hx FROM m GROUP BY 1, 2) b ON b.step = t.step AND b.hid = t.nowhid")
def j13_attach_mbp_phase_space(spark, sf):
    rows = members(spark, sf)
    hosts = rows.groupBy("step", "hid").agg(F.sum("e").alias("hx"))
    return T.attach_phase_space(tree(spark, sf), rows.select("step", "indx", F.col("e").alias("x")), hosts).select("step", "gid", "x", "hx")


_HEAVY = "hv AS (SELECT * FROM links WHERE step = {s} ORDER BY mass DESC, mbp LIMIT 1)"
_CHAIN = "ch(step, mbp) AS (SELECT step, mbp FROM st0 UNION ALL SELECT l.step, l.mbp FROM ch JOIN links l ON l.step = ch.step {d} 1 AND l.mbp = ch.mbp)"


@query(f"WITH RECURSIVE {links_sql()}, {_HEAVY.format(s=LAST)}, st0 AS (SELECT step, mbp FROM hv), {_CHAIN.format(d='-')} SELECT l.step, l.mbp, l.nowhid, l.mass FROM links l JOIN ch USING (step, mbp)")
def j14_trace_down(spark, sf):
    all_links = cut(links(spark, sf))
    start = all_links.filter(F.col("step") == LAST).orderBy(F.desc("mass"), "mbp").limit(1)
    return L.trace(all_links, start, True, STEPS).select("step", "mbp", "nowhid", "mass")


@query(f"WITH RECURSIVE {links_sql()}, {_HEAVY.format(s=LAST)}, st0 AS (SELECT l.step, l.mbp FROM links l JOIN hv ON hv.nowhid = l.nowhid AND l.step = {LAST}), {_CHAIN.format(d='-')} SELECT l.step, l.mbp, l.nowhid, CASE WHEN (status & 2) <> 0 THEN 'A' WHEN (status & 1) <> 0 THEN 'N' WHEN (status & 4) <> 0 THEN 'J' WHEN (status & 8) <> 0 THEN 'I' ELSE 'U' END AS code FROM links l JOIN ch USING (step, mbp)")
def j15_trace_down_all(spark, sf):
    from ..functions.scalars import status_code

    all_links = cut(links(spark, sf))
    last = all_links.filter(F.col("step") == LAST)
    host = last.orderBy(F.desc("mass"), "mbp").limit(1).select("nowhid")
    return L.trace(all_links, last.join(host, "nowhid", "left_semi"), True, STEPS).select("step", "mbp", "nowhid", status_code(F.col("status")).alias("code"))


@query(f"WITH RECURSIVE {links_sql()}, {_HEAVY.format(s=0)}, st0 AS (SELECT step, mbp FROM hv), {_CHAIN.format(d='+')} SELECT l.step, l.mbp, l.nowhid, l.mass FROM links l JOIN ch USING (step, mbp)")
def j16_trace_up(spark, sf):
    all_links = cut(links(spark, sf))
    start = all_links.filter("step = 0").orderBy(F.desc("mass"), "mbp").limit(1)
    return L.trace(all_links, start, False, STEPS).select("step", "mbp", "nowhid", "mass")


@query(f"WITH {TREE} SELECT step, gid, majorgid FROM tree")
def w1_major_gid(spark, sf):
    return T.major_gid(tree(spark, sf).drop("majorgid")).select("step", "gid", "majorgid")


@query(f"WITH {links_sql()} SELECT step, mbp, lineflag, mass FROM links WHERE lineflag > 0")
def w2_major_progenitor(spark, sf):
    return links(spark, sf).filter("lineflag > 0").select("step", "mbp", "lineflag", "mass")


@query(f"WITH {TREE}, gr AS (SELECT gid, s AS step FROM (SELECT DISTINCT gid FROM tree), (SELECT unnest(range({STEPS})) AS s)), x AS (SELECT gr.gid, gr.step, CASE WHEN t.gid IS NULL THEN 0 ELSE 1 END AS here FROM gr LEFT JOIN tree t ON t.gid = gr.gid AND t.step = gr.step) SELECT gid, CAST(sum(sw) AS BIGINT) AS switches FROM (SELECT gid, CASE WHEN here <> lag(here) OVER (PARTITION BY gid ORDER BY step) THEN 1 ELSE 0 END AS sw FROM x) GROUP BY 1")
def w4_history_transitions(spark, sf):
    return T.transitions(tree(spark, sf), list(range(STEPS)))


@query("SELECT l_partkey AS hid, CAST(count(*) AS BIGINT) AS gaps FROM (SELECT l_partkey, o - lag(o) OVER (PARTITION BY l_partkey ORDER BY o) AS d FROM (SELECT DISTINCT l_partkey, l_orderkey AS o FROM lineitem)) WHERE d > 60 GROUP BY 1")
def w5_gap_detection(spark, sf):
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("hid"), F.col("l_orderkey").alias("o")).distinct()
    d = F.col("o") - F.lag("o").over(Window.partitionBy("hid").orderBy("o"))
    return rows.withColumn("d", d).filter("d > 60").groupBy("hid").agg(F.count("*").alias("gaps"))


_Q = "CAST(min(CASE WHEN cum > {q}e0*total THEN bin END) AS BIGINT) AS {n}"
_QUANT = """b AS (SELECT sample, step, bin, count(*) AS n FROM rw GROUP BY 1, 2, 3), cu AS (SELECT *, sum(n) OVER (PARTITION BY sample, step ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY sample, step) AS total FROM b)
SELECT CAST(sample AS INTEGER) AS sample, step, CAST(max(total) AS BIGINT) AS n, """ + ", ".join(_Q.format(q=q, n=f"q{k}") for k, q in enumerate((0.317, 0.5, 0.683))) + " FROM cu WHERE total >= 10 GROUP BY 1, 2"
SAMPLES, FINE = [(0.0, 100.0), (100.0, 1000.0)], [(10.0**a, 10.0 ** (a + 0.25)) for a in (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5)]


def _samples(samples) -> str:
    return "sm AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a!r}e0, {b!r}e0)" for k, (a, b) in enumerate(samples)) + ") t(sample, a, b)), fin AS (SELECT gid, mass AS m0 FROM tree WHERE step = " + str(LAST) + ")"


def _mah_sql(samples) -> str:
    return f"WITH {TREE}, {_samples(samples)}, rw AS (SELECT sample, step, least(CAST(floor(mass*1024/CAST(m0 AS DOUBLE)) AS BIGINT), 1023) AS bin FROM tree JOIN fin USING (gid), sm WHERE m0 >= a AND m0 < b), {_QUANT}"


@query(_mah_sql(SAMPLES))
def a29_mass_accretion_history(spark, sf):
    return T.accretion(tree(spark, sf), LAST, SAMPLES)


@query(f"WITH {TREE}, {_samples(SAMPLES)}, rw AS (SELECT sample, step, least(CAST(floor(psi*204.8e0 + 1e-9) AS BIGINT), 1023) AS bin FROM (SELECT sample, step, -ln(mass/CAST(m0 AS DOUBLE))/({LAST}-step) AS psi FROM tree JOIN fin USING (gid), sm WHERE m0 >= a AND m0 < b AND step < {LAST}) WHERE psi BETWEEN 0 AND 5), {_QUANT}")
def a29_accretion_slope(spark, sf):
    return T.accretion_slope(tree(spark, sf), LAST, F.lit(LAST) - F.col("step"), SAMPLES)


@query(_mah_sql(FINE))
def a30_fine_accretion_history(spark, sf):
    return T.accretion(tree(spark, sf), LAST, FINE)


@query(f"""WITH b AS (SELECT c_nationkey AS host, CAST(floor(c_acctbal/100) AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY host ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY host) AS total FROM b)
SELECT host, CAST(max(total) AS BIGINT) AS n, CAST(min(CASE WHEN cum > 0.25e0*total THEN bin END) AS BIGINT) AS q0, CAST(min(CASE WHEN cum > 0.75e0*total THEN bin END) AS BIGINT) AS q1 FROM c WHERE total >= 10 GROUP BY 1""")
def w6_histogram_quantile(spark, sf):
    from ..operators.massfunc import histogram_quantiles

    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("host"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("bin"))
    return histogram_quantiles(rows, ["host"], "bin", [0.25, 0.75], 10)


@query(f"WITH {TREE}, hl AS (SELECT log10(CAST(fofhmass AS DOUBLE)) AS lm FROM tree WHERE step = {LAST - 1} AND gid = majorgid), {MF.format(nbin=8)}")
def a28_tree_mass_function(spark, sf):
    return _rounded(T.tree_mass_function(tree(spark, sf), LAST - 1, 8))


@query(f"WITH {TREE}, hl AS (SELECT log10(CAST(mass AS DOUBLE)) AS lm FROM tree WHERE step = {LAST} AND mass > 0 AND gid <> majorgid), {MF.format(nbin=8)}")
def a28_orphan_mass_function(spark, sf):
    """Lines that lost their major line: here those that aren't their own."""
    t = tree(spark, sf).withColumn("majorgid", F.when(F.col("gid") == F.col("majorgid"), F.col("gid")))
    return _rounded(T.orphan_mass_function(t, LAST, 8))


@query(f"WITH {SORTED} SELECT step, gid, majorgid, mbp, mass FROM st")
def t3_sort_by_major_gid(spark, sf):
    return T.sort_by_major(tree(spark, sf), LAST).select("step", "gid", "majorgid", "mbp", "mass")


@query(f"WITH {SORTED} SELECT step, gid, mbp, row_number() OVER (ORDER BY gid, step) - 1 AS place FROM st")
def t4_finalize_sorted_tree(spark, sf):
    """With each row's place in the order that comes out."""
    return numbered(T.finalize(T.sort_by_major(tree(spark, sf), LAST)).select("step", "gid", "mbp"))


@query(f"WITH {links_sql()} SELECT step, bin, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE NOT there) AS BIGINT) AS missing FROM (SELECT step, CAST(floor(log10(CAST(mass AS DOUBLE))*4 + 1e-9) AS BIGINT) AS bin, EXISTS (SELECT 1 FROM links b WHERE b.step = a.step + 1 AND b.mbp = a.mbp) AS there FROM links a WHERE a.step < {LAST}) GROUP BY 1, 2")
def v1_missing_link_fraction(spark, sf):
    all_links = cut(links(spark, sf))
    return _union([checks.missing_link_fraction(all_links.filter(F.col("step") == s), all_links.filter(F.col("step") == s + 1)).withColumn("step", F.lit(s)) for s in range(LAST)])


@query(f"WITH {links_sql()}, spoilt AS (SELECT step, nowhid, mass, fofhmass FROM links UNION ALL SELECT step, nowhid, mass, fofhmass FROM links WHERE mbp % 7 = 0) SELECT step, nowhid, CAST(count(*) AS BIGINT) AS n FROM spoilt WHERE mass = fofhmass GROUP BY 1, 2 HAVING count(*) > 1")
def v2_duplicate_hosts(spark, sf):
    """On links of which some are there twice: sound ones have no violation."""
    found = cut(links(spark, sf))
    return checks.duplicate_hosts(found.unionByName(found.filter("mbp % 7 = 0")))


@query(f"WITH {TREE} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE mass < 100) AS BIGINT) AS low FROM tree WHERE step = {LAST}")
def v3_low_final_mass_fraction(spark, sf):
    return checks.low_final_mass(tree(spark, sf), LAST, 100.0)


@query(f"WITH {TREE}, ln AS (SELECT CAST(count(DISTINCT gid) AS BIGINT) AS lines FROM tree) SELECT s AS step, lines, lines - CAST((SELECT count(*) FROM tree t WHERE t.step = s) AS BIGINT) AS nulls FROM (SELECT CAST(unnest(range({STEPS})) AS INTEGER) AS s), ln")
def v4_null_mbp_fraction(spark, sf):
    t = tree(spark, sf)
    return checks.null_mbp(t, t.select("gid").distinct(), list(range(STEPS)))


@query(f"WITH {TREE} SELECT gid, CAST(count(DISTINCT mbp) AS BIGINT) AS n FROM (SELECT gid, CASE WHEN gid % 5 = 0 THEN mbp + step // 2 ELSE mbp END AS mbp FROM tree) GROUP BY 1 HAVING count(DISTINCT mbp) > 1")
def v5_mbp_constant_in_history(spark, sf):
    """On a tree of which some lines change their MBP: a sound one has no violation."""
    return checks.changing_mbp(tree(spark, sf).withColumn("mbp", F.when(F.col("gid") % 5 == 0, F.col("mbp") + F.expr("step div 2")).otherwise(F.col("mbp"))))


@query(f"WITH {TREE} SELECT step, CAST(count(*) AS BIGINT) AS n FROM (SELECT gid, max(step) AS step FROM tree GROUP BY 1) WHERE step < {LAST} GROUP BY 1")
def v6_history_gap_count(spark, sf):
    return checks.vanished(tree(spark, sf), LAST)


@query(f"WITH {TREE} SELECT gid, CAST(sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM (SELECT gid, step - lag(step) OVER (PARTITION BY gid ORDER BY step) AS gap FROM tree WHERE (gid + step) % 3 > 0) GROUP BY 1 HAVING sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) > 0")
def v6_history_gaps(spark, sf):
    """On a tree of which some rows are taken out: a sound one has no gap."""
    return checks.history_gaps(tree(spark, sf).filter((F.col("gid") + F.col("step")) % 3 > 0))


@query(f"WITH {TREE} SELECT gid, step, majorgid FROM (SELECT gid, step, CASE WHEN gid % 4 = 0 THEN majorgid + 1 ELSE majorgid END AS majorgid, row_number() OVER (PARTITION BY gid ORDER BY step) AS rn FROM tree) WHERE rn = 1 AND gid <> majorgid")
def v7_birth_major_is_self(spark, sf):
    """On a tree of which some lines have another's major line: a sound one has no violation."""
    return checks.birth_not_major(tree(spark, sf).withColumn("majorgid", F.when(F.col("gid") % 4 == 0, F.col("majorgid") + 1).otherwise(F.col("majorgid"))))


@query("SELECT side, n, total FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders), (VALUES ('before'), ('after')) t(side)")
def v8_row_conservation(spark, sf):
    return checks.row_conservation(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", shared_dir(spark))


@query(f"WITH {links_sql()} SELECT step, CAST(count(*) AS BIGINT) AS n FROM links GROUP BY 1")
def u1_union_steps(spark, sf):
    all_links = cut(links(spark, sf))
    return _union([all_links.filter(F.col("step") == s) for s in range(STEPS)]).groupBy("step").agg(F.count("*").alias("n"))
