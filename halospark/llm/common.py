"""What the text operators share: normalising and skew-safe joins; scratch tables and components are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import cut, discard, shared_dir

__all__ = ["HOT_SHARE", "ascii_lower", "attach", "components", "cut", "discard", "drop_copies", "least_hashed", "shared_dir", "table", "text_digest"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A key that holds more than one row in HOT_SHARE is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_digest(text: str) -> Column:
    """SHA-256, in hex, of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)


def drop_copies(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that pairs drops. pairs: (_id, _digest, _kept, _n), each id and text_digest() once, with whether one
    of its _n rows stays; the others go. Rows not in pairs stay. All columns of docs are kept, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_digest(text_col).alias("sha"))
    same = lambda p: rows["id"].eqNullSafe(p["_id"]) & (rows["sha"] == p["_digest"])
    # "merge": the copies grow with the rows, so the join is one that doesn't change with their size
    gone, again = pairs.filter("not _kept").hint("merge"), pairs.filter("_kept and _n > 1")
    out = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():  # rows that repeat an id and its text
        one = rows.join(again, same(again), "left_semi").dropDuplicates(["id", "sha"])
        both = pairs.filter("not _kept or _n > 1").hint("merge")
        out = rows.join(both, same(both), "left_anti").unionByName(one)
    return out.select("row.*")


def least_hashed(rows: DataFrame, h: Column, n: int, total: int | None = None, *ties) -> DataFrame:
    """About n rows, at most n: those with the least h, a 64-bit hash. Rows over a threshold from the count are left out first, so that
    no partition sorts or sends n rows of its own."""
    total = rows.count() if total is None else total
    if total > n:
        part = min(1.0, (1.1 * n + 6 * n**0.5 + 20) / total)
        rows = rows.filter(h < F.lit(int(-(2**63) + part * (2**64 - 2**11))))
    return rows.orderBy(h, *ties).limit(n)


def attach(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """left LEFT JOIN right on non-null keys, whole under skew. right has a row for each key, and in `size` the number of left
    rows with it. Keys with over total/HOT_SHARE rows, at most HOT_SHARE of them, are broadcast; their rows of left are not shuffled."""
    least = max(1, total // HOT_SHARE)
    hot, cold = F.broadcast(right.filter(F.col(size) > least)), right.filter(F.col(size) <= least)
    if hot.isEmpty():
        return left.join(right, keys, "left")
    return left.join(hot, keys).unionByName(left.join(hot, keys, "left_anti").join(cold, keys, "left"))
