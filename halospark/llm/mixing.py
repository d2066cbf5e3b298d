"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected between 0 (all
sources alike) and 1 (as they are): to the weights of the target entropy, or, if these would repeat a source's documents more
often than allowed, to the smallest exponent that keeps the limit. Each source's part of the token budget is then drawn as
whole permutations of its documents and, for the rest, the start of one more. A permutation is the order of a keyed digest,
whose leading digits deal a source's documents to blocks; running sums over the blocks find the block in which the budget
ends, and running sums in that block the last document's digest. So no source is sorted or summed in one task, and a document
is in the rest exactly if its digest isn't above its source's last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, table

ENTROPY, REPEATS, BUDGET, SEED = 0.97, 4.0, 1.0, 17
#: Of the query: nearly even sources, at most four times each, half as many tokens again, so that sources repeat and end within a permutation.
EVEN, TIMES, MORE = 0.999, 4.0, 1.5
WORD = r"[^\x20\x09-\x0D]+"
WAYS, ROUNDS, DIGITS = 32, 9, 9
#: Rows that a block of a permutation has on average, at most.
BLOCK_ROWS = 20_000


def exponent(shares: DataFrame, entropy: float, repeats: float, budget: float) -> float:
    """The exponent for shares p (positive, sum 1). entropy: as a part of that of equal weights."""
    n, least = shares.agg(F.count("*"), F.min("p")).first()
    if not n or n == 1:
        return 1.0
    full = shares.agg(F.log(F.count("*").cast("double"))).first()[0] * entropy

    def search(ok) -> float:
        """The largest a in 0..1 below which ok fails, ok(sum p^a, sum p^a ln p, a) holding from it on."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * k / WAYS for k in range(WAYS + 1)]
            sums = shares.agg(*(f for a in grid for f in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p"))))).first()
            good = [ok(sums[2 * k], sums[2 * k + 1], a) for k, a in enumerate(grid)]
            if good[0]:
                return lo
            if not any(good):
                return hi
            k = good.index(True)
            lo, hi = grid[k - 1], grid[k]
        return hi

    import math

    by_entropy = search(lambda s, l, a: math.log(s) - a * l / s <= full)
    by_repeats = search(lambda s, l, a: budget * least ** (a - 1) / s <= repeats)
    return round(max(by_entropy, by_repeats), DIGITS)


def order_key(id_col: str, epoch) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> DataFrame:
    """A row for each source: source, rows, tokens, weight, quota (tokens), epochs (whole ones), last_key (of the next, null: none).

    budget: the mix's tokens as a multiple of those of docs. Tokens are words between ASCII white space; null text has none. A null source is
    one of its own. A source without tokens takes no budget and is kept once. If even the natural shares repeat too often, they are taken.

    entropy is a floor: the exponent is at most 1, so sources that are more even than that keep their natural shares."""
    rows = cut(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("tokens")))
    sources = cut(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")))
    total, most = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    shares = sources.filter("tokens > 0").select(F.col("source").alias("s"), (F.col("tokens") / F.lit(float(total or 1))).alias("p"))
    a = exponent(shares, entropy, repeats, budget)
    powers = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))
    norm = sources.filter("tokens > 0").agg(F.sum(powers)).first()[0] or 1.0
    quota = F.floor(F.col("weight") * F.lit(float(budget * total))).cast("long")
    plan = sources.withColumn("weight", F.when(F.col("tokens") > 0, powers / F.lit(norm)).otherwise(0.0)).withColumn("quota", quota)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1))
    plan = cut(plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(0)))
    digits = 1
    while 16**digits * BLOCK_ROWS < most and digits < 8:
        digits += 1
    keyed = attach(rows.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), plan.filter("rest > 0").select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("s"), "rows", "epochs", "rest"), ["s"], "rows", rows.count())
    keyed = cut(keyed.filter("rest is not null").withColumn("key", order_key("id", F.col("epochs"))).select("s", "tokens", "rest", "key", F.substring("key", 1, digits).alias("block")))
    sums = keyed.groupBy("s", "block").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("s").orderBy("block")))
    ends = cut(sums.filter("upto > rest").groupBy("s").agg(F.min(F.struct("block", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select("s", "e.block", "e.before"))
    inner = keyed.join(ends, ["s", "block"]).withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("s", "block").orderBy("key")))
    last = inner.filter("upto <= rest").groupBy("s").agg(F.max("key").alias("key"))
    last = ends.join(last, "s", "left").select("s", F.coalesce("key", "block").alias("last_key"))
    plan = plan.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).join(last, "s", "left")
    return cut(plan.select("source", "rows", "tokens", "weight", "quota", "epochs", "last_key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with mix_epoch (from 0) and mix_key: sorted by these two, each
    source's rows come as its permutations. Rows that repeat an id have one key and come or go together. Null texts have no
    tokens and come as their place among the others says. Columns mix_epoch and mix_key of docs are replaced, others kept
    whatever their names. An empty table gives an empty mix."""
    plan = plan_mix(docs, id_col, text_col, source_col, **target)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    n = plan.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    by_source = plan.select(key("source").alias("s"), "rows", "epochs", "last_key")
    kept = [c for c in docs.columns if c not in ("mix_epoch", "mix_key")]
    rows = docs.select(F.struct(*(docs[c] for c in kept)).alias("row"), F.col(id_col).alias("id"), key(source_col).alias("s"))
    dealt = attach(rows, by_source, ["s"], "rows", n)
    more = F.coalesce((order_key("id", F.col("epochs")) <= F.col("last_key")).cast("int"), F.lit(0))
    dealt = dealt.withColumn("n", (F.col("epochs") + more).cast("int")).filter("n > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.select("row.*", "mix_epoch", order_key("id", F.col("mix_epoch")).alias("mix_key"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), entropy=EVEN, repeats=TIMES, budget=MORE).select("doc_id", "source", "mix_epoch", "mix_key")


SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
s AS MATERIALIZED (SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM d GROUP BY 1),
p AS MATERIALIZED (SELECT source, t, CAST(t AS DOUBLE) / (SELECT CAST(sum(t) AS DOUBLE) FROM s) AS p FROM s),
b(i, elo, ehi, rlo, rhi) AS (
  SELECT 0, 0e0, 1e0, 0e0, 1e0
  UNION ALL
  SELECT i + 1, CASE WHEN eok THEN elo ELSE (elo + ehi) / 2 END, CASE WHEN eok THEN (elo + ehi) / 2 ELSE ehi END,
         CASE WHEN rok THEN rlo ELSE (rlo + rhi) / 2 END, CASE WHEN rok THEN (rlo + rhi) / 2 ELSE rhi END
  FROM (SELECT i, elo, ehi, rlo, rhi, max(e.h) <= {EVEN} * max(e.full_h) AS eok, {MORE}e0 * max(e.rep) <= {TIMES} AS rok FROM (
    SELECT b.*, ln(es) - (elo + ehi) / 2 * el / es AS h, ln(n) AS full_h, pow(pmin, (rlo + rhi) / 2 - 1) / rs AS rep FROM (
      SELECT b.i, b.elo, b.ehi, b.rlo, b.rhi, sum(pow(p.p, (elo + ehi) / 2)) AS es, sum(pow(p.p, (elo + ehi) / 2) * ln(p.p)) AS el,
             sum(pow(p.p, (rlo + rhi) / 2)) AS rs, min(p.p) AS pmin, CAST(count(*) AS DOUBLE) AS n FROM b, p WHERE b.i < 48 GROUP BY ALL) b) e GROUP BY ALL)),
a AS (SELECT round(greatest(CASE WHEN ehi < 1e-12 THEN 0 ELSE ehi END, CASE WHEN rhi < 1e-12 THEN 0 ELSE rhi END), {DIGITS}) AS a FROM b WHERE i = 48),
w AS MATERIALIZED (SELECT source, t, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a) * CAST({MORE}e0 * (SELECT sum(t) FROM s) AS DOUBLE)) AS BIGINT) AS quota FROM p, a),
k AS (SELECT d.doc_id, d.source, d.tokens, w.quota // w.t AS epochs, w.quota % w.t AS rest, md5('{SEED}:' || CAST(w.quota // w.t AS VARCHAR) || ':' || CAST(d.doc_id AS VARCHAR)) AS key FROM d JOIN w USING (source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
n AS (SELECT doc_id, source, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM c)
SELECT doc_id, source, CAST(e AS INTEGER) AS mix_epoch, md5('{SEED}:' || CAST(e AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS mix_key
FROM (SELECT doc_id, source, unnest(range(n)) AS e FROM n)
"""
