"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition makes a run of (digest, representative, rows). Runs meet in rounds: in each, FAN neighbouring runs are
merged by digest, so that a text of any number of copies adds at most FAN rows to a merge and no digest ever meets all its rows
in one task. The winners then go down the same tree, again at most FAN rows a key, to the rows of their run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_copies, table

FAN = 16
#: A digest counts as verified when the length and an independent 64-bit hash of the text agree too.
KEY = ["digest", "n_bytes", "verify"]


def _norm(text: str):
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null texts count as empty, and all empty texts form one group. Of a
    group exactly one row is kept, that of the smallest or largest id; null ids lose to any other, and rows that repeat one id
    are ties that one of them wins. Other columns are ignored. An empty table gives an empty result."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    norm = _norm(text_col)
    rows = cut(docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(norm, 256)).alias("digest"), F.octet_length(norm).cast("long").alias("n_bytes"),
        F.xxhash64(norm).alias("verify"), F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("row"),
    ))
    best = F.min if keep == "smallest" else F.max
    null_last = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    runs = rows.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]
    level = rows.groupBy("run", *KEY).agg(best(F.struct(null_last.alias("r"), "id", "row")).alias("keep"), F.count("*").alias("n"))
    levels = [cut(level)]
    while runs > 1:
        runs = -(-runs // FAN)
        up = levels[-1].withColumn("run", F.expr(f"run div {FAN}"))
        levels.append(cut(up.groupBy("run", *KEY).agg(best("keep").alias("keep"), F.sum("n").alias("n"))))
    won = levels[-1].filter("n > 1").select("run", *KEY, "keep", "n")
    for below in reversed(levels[:-1]):
        here = below.select(F.col("run").alias("low"), F.expr(f"run div {FAN}").alias("run"), *KEY)
        won = here.join(won, ["run", *KEY]).select(F.col("low").alias("run"), *KEY, "keep", "n")
    out = rows.join(won, ["run", *KEY], "left")
    alone = F.col("keep").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, one for each text, with all columns."""
    found = exact_duplicates(docs, id_col, text_col, keep).filter("group_size > 1")
    pairs = cut(found.groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_digest")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")))
    return drop_copies(docs, pairs, id_col, text_col)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
