"""Registration of queries with their SQL, and pieces of SQL that several share."""

from __future__ import annotations

from .fixtures import BOX, CLUMPS, LINK, MEMBERS, MIN_MEMBERS, MIN_NP, OBSERVERS, PARTICLES

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name; without SQL it is compared by rows and by the tests."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def near(a: str, b: str, box: int = BOX) -> str:
    """SQL: squared periodic distance of two tables' rows."""
    return " + ".join(f"least(abs({a}.{c}-{b}.{c}), {box}-abs({a}.{c}-{b}.{c}))*least(abs({a}.{c}-{b}.{c}), {box}-abs({a}.{c}-{b}.{c}))" for c in "xyz")


PAIRS = f"""p AS MATERIALIZED ({PARTICLES}),
k AS MATERIALIZED (SELECT *, (x//64)*65536+(y//64)*256+z//64 AS ck FROM p),
o AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM (VALUES(-1),(0),(1)) a(d),(VALUES(-1),(0),(1)) b(d),(VALUES(-1),(0),(1)) c(d)),
n AS MATERIALIZED (SELECT k.*, ((x//64+dx+256)%256)*65536+((y//64+dy+256)%256)*256+((z//64+dz+256)%256) AS nk FROM k CROSS JOIN o),
pr AS MATERIALIZED (SELECT u.indx AS i, v.indx AS j, {near("u", "v")} AS r2 FROM n u JOIN k v ON v.ck=u.nk WHERE u.indx<>v.indx AND {near("u", "v")} <= {LINK * LINK})"""
#: lab(indx, label) of every particle; needs WITH RECURSIVE.
LABELS = f"""{PAIRS},
r(i,l) AS (SELECT indx,indx FROM p UNION SELECT pr.j,r.l FROM r JOIN pr ON pr.i=r.i),
lab AS MATERIALIZED (SELECT i AS indx, min(l) AS label FROM r GROUP BY i),
big AS MATERIALIZED (SELECT label, CAST(count(*) AS BIGINT) AS np FROM lab GROUP BY label HAVING count(*) >= {MIN_NP})"""


def links_sql(steps: int = 5) -> str:
    """CTEs m, h and links(step, mbp, nowhid, mass, fofhmass, status, lineflag, prevhid, prevmass)."""
    out = f"""m AS MATERIALIZED ({MEMBERS}),
h AS MATERIALIZED (SELECT step, hid, CAST(count(*) AS BIGINT) AS np, CAST(min(e*1000000000 + indx) % 1000000000 AS BIGINT) AS own FROM m GROUP BY 1, 2 HAVING count(*) >= {MIN_MEMBERS}),
l0 AS MATERIALIZED (SELECT 0 AS step, own AS mbp, hid AS nowhid, np AS mass, np AS fofhmass, 1 AS status, 0 AS lineflag, CAST(NULL AS BIGINT) AS prevhid, CAST(NULL AS BIGINT) AS prevmass FROM h WHERE step = 0)"""
    for s in range(1, steps):
        out += f""",
c{s} AS MATERIALIZED (SELECT m.indx AS mbp, m.hid, h.np, p.nowhid AS prevhid, p.mass AS prevmass, row_number() OVER (PARTITION BY m.hid ORDER BY p.mass DESC, m.indx) AS rk, count(*) OVER (PARTITION BY m.hid) AS n
  FROM m JOIN h ON h.step = m.step AND h.hid = m.hid JOIN l{s - 1} p ON p.mbp = m.indx WHERE m.step = {s}),
l{s} AS MATERIALIZED (SELECT {s} AS step, mbp, hid AS nowhid, CASE WHEN rk = 1 THEN np ELSE prevmass END AS mass, np AS fofhmass, CASE WHEN n = 1 THEN 2 ELSE 4 END AS status, CASE WHEN n = 1 THEN 0 WHEN rk = 1 THEN 1 ELSE 2 END AS lineflag, prevhid, prevmass FROM c{s}
  UNION ALL SELECT {s}, own, hid, np, np, 1, 0, NULL, NULL FROM h WHERE step = {s} AND hid NOT IN (SELECT hid FROM c{s}))"""
    return out + ",\nlinks AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{s}" for s in range(steps)) + ")"


#: tree: links with gid (dense, by first step and mbp) and majorgid.
TREE = (
    links_sql()
    + """,
isl AS (SELECT *, sum(nw) OVER (PARTITION BY mbp ORDER BY step) AS island FROM (SELECT *, CASE WHEN step - coalesce(lag(step) OVER (PARTITION BY mbp ORDER BY step), -10) > 1 THEN 1 ELSE 0 END AS nw FROM links)),
gids AS (SELECT mbp, island, row_number() OVER (ORDER BY birth, mbp) - 1 AS gid FROM (SELECT mbp, island, min(step) AS birth FROM isl GROUP BY 1, 2)),
tree AS MATERIALIZED (SELECT isl.* EXCLUDE (nw, island), gid, first(gid) OVER (PARTITION BY step, nowhid ORDER BY mass DESC, gid) AS majorgid FROM isl JOIN gids USING (mbp, island))"""
)
TREE_COLUMNS = "step, mbp, nowhid, mass, fofhmass, status, lineflag, prevhid, prevmass, gid, majorgid"
_TSC = "CASE d WHEN 0 THEN 0.75e0-f*f ELSE 0.5e0*(0.25e0+f*f+d*f) END"


def tsc_sql(mesh: int, shift: int, value: str = "1e0", name: str = "g") -> str:
    """CTEs up to name(ix, iy, iz, value): the deposit of p (the particles) with positions floor(x/shift)/16 in cells."""
    axis = lambda c: f"SELECT indx, CAST((n+d+{mesh})%{mesh} AS BIGINT) AS c, {_TSC} AS w FROM (SELECT indx, CAST(floor(q+0.5e0) AS BIGINT) AS n, q-floor(q+0.5e0) AS f, d FROM (SELECT indx, floor({c}/{shift}e0)/16e0 AS q FROM p), (VALUES(-1),(0),(1)) t(d))"
    return f"""ax{name} AS MATERIALIZED ({axis("x")}), ay{name} AS MATERIALIZED ({axis("y")}), az{name} AS MATERIALIZED ({axis("z")}),
{name} AS MATERIALIZED (SELECT a.c AS ix, b.c AS iy, z.c AS iz, sum(a.w*b.w*z.w*({value})) AS value FROM ax{name} a JOIN ay{name} b USING (indx) JOIN az{name} z USING (indx) JOIN p USING (indx) GROUP BY 1, 2, 3)"""


CENTRED = f"""c AS MATERIALIZED ({CLUMPS}),
mean AS (SELECT hid, {', '.join(f'avg({v}) AS m{v}' for v in ('x', 'y', 'z', 'vx', 'vy', 'vz'))}, CAST(count(*) AS BIGINT) AS np FROM c GROUP BY 1),
d AS MATERIALIZED (SELECT c.*, np, {', '.join(f'{v} - m{v} AS d{v}' for v in ('x', 'y', 'z', 'vx', 'vy', 'vz'))} FROM c JOIN mean USING (hid))"""
SEEN = f"""p AS MATERIALIZED ({PARTICLES}), o AS ({OBSERVERS}),
s AS MATERIALIZED (SELECT *, dx*dx+dy*dy+dz*dz AS r2 FROM (SELECT p.*, o.iobs, {', '.join(f"CASE WHEN (p.{c}-o.o{c})*2 > {BOX} THEN p.{c}-o.o{c}-{BOX} WHEN (p.{c}-o.o{c})*2 < -{BOX} THEN p.{c}-o.o{c}+{BOX} ELSE p.{c}-o.o{c} END AS d{c}" for c in 'xyz')} FROM p CROSS JOIN o))"""
