"""SimHash near-duplicates, linked by searches in BK-trees.

Fingerprints within 3 bits of each other agree in at least one of four 16-bit blocks. So fingerprints are dealt to shards by
(block, value), and each task builds its shards' BK-trees, a node's children keyed by their Hamming distance to it, and searches
them with the shard's fingerprints along the edges within the radius. A tree goes only to the task whose fingerprints can have
links in it, as a broadcast of all trees would grow with the corpus. A shard of more than TREE fingerprints is dealt once more, by the
blocks of the other 48 bits, of which one must agree too, so each of its fingerprints goes to four smaller shards. Should one of these be
over TREE, it becomes several trees of about that size, and its fingerprints stream past each. Copies share a fingerprint and are collapsed
before; a shard gives the links of a spanning forest, not all pairs, and the components of all shards' links are the groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, cut, drop_copies, table, text_digest

SEED, WORDS, RADIUS, TREE = 42, 3, 3, 20_000
_SHIFT = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """64-bit SimHash over n-word shingles with repeats, unsigned. No words, empty or null text: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - n].tolist()]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[s:e], SEED) for s, e in zip(starts, (ends[n - 1 :] - 1).tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):  # bounded memory for any text
        ones += np.unpackbits(hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _SHIFT).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), n) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


class BKTree:
    """Nodes are numbered as they come; a node's children are keyed by their distance to it."""

    def __init__(self):
        self.values, self.children = [], []

    def add(self, value: int) -> None:
        """value must not be in the tree."""
        k, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while k < new:
            d = (self.values[k] ^ value).bit_count()
            k = self.children[k].setdefault(d, new)

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            k = stack.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            edges = children[k]
            if len(edges) < 2 * radius + 1:
                stack += [c for e, c in edges.items() if -radius <= e - d <= radius]
            else:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found


class _Forest:
    """A tree that grows, and links (value, value) of a spanning forest over what was found within the radius."""

    def __init__(self, radius: int):
        self.tree, self.radius, self.up = BKTree(), radius, {}

    def _root(self, v):
        up = self.up
        while (h := up.get(v, v)) != v:
            up[v] = v = up.get(h, h)
        return v

    def meet(self, v: int, grow: bool):
        for k in self.tree.within(v, self.radius):
            a, b = self._root(v), self._root(self.tree.values[k])
            if a != b:
                self.up[max(a, b)] = min(a, b)
                yield v, self.tree.values[k]
        if grow:
            self.tree.add(v)


def _cut_bits(fp, width: int, blocks: int):
    """(block, value) of `blocks` cuts of the low `width` bits."""
    edges = [width * k // blocks for k in range(blocks + 1)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << edges[k + 1] - edges[k]) - 1)).alias("value")) for k in range(blocks)))


def link(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b): links that connect all fp of prints (distinct longs) within radius bits of each other, for radius 0 to 15.

    The 64 bits, and in shards over `tree` what is left of them, are cut in 4 blocks for a radius up to 3, else radius + 1."""
    blocks = max(4, radius + 1)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    dealt = prints.select("fp", F.explode(_cut_bits(F.col("fp"), 64, blocks)).alias("k")).select("fp", "k.block", "k.value")
    sizes = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    dealt = dealt.join(sizes(dealt, "block", "value"), ["block", "value"])
    none = F.struct(F.lit(-1).alias("block"), F.lit(-1).cast("long").alias("value"))
    whole = dealt.filter(F.col("n") <= tree).select("fp", "block", "value", none.alias("sub"), "n")
    large = dealt.filter(F.col("n") > tree)
    others = F.coalesce(*(F.when(F.col("block") == k, F.shiftleft(F.shiftrightunsigned("fp", edges[k + 1]) if k + 1 < blocks else F.lit(0).cast("long"), edges[k]).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << edges[k]) - 1)))) for k in range(blocks)))
    most = max(64 - (edges[k + 1] - edges[k]) for k in range(blocks))
    again = large.withColumn("rest", others).withColumn("sub", F.explode(_cut_bits(F.col("rest"), most, blocks))).select("fp", "block", "value", "sub")
    again = again.join(sizes(again, "block", "value", "sub"), ["block", "value", "sub"]).select("fp", "block", "value", "sub", "n")
    dealt = whole.unionByName(again).withColumn("parts", F.ceil(F.col("n") / tree).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["block", "value", "sub_block", "sub_value", "part"]
    dealt = dealt.select("block", "value", F.col("sub.block").alias("sub_block"), F.col("sub.value").alias("sub_value"), "part", "fp", (F.col("own") == F.col("part")).alias("own"))
    dealt = dealt.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, F.desc("own"))

    def search(batches):
        at, forest = None, None
        for b in batches:
            found: list[tuple[int, int]] = []
            keys = list(zip(*(b.column(k).to_pylist() for k in range(5))))
            for key, v, grow in zip(keys, b.column(5).to_numpy(zero_copy_only=False).view(np.uint64).tolist(), b.column(6).to_pylist()):
                if key != at:
                    at, forest = key, _Forest(radius)
                found += forest.meet(v, grow)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*found)], names=["a", "b"])

    return dealt.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """A row for each row of docs: id, fingerprint (16 hex digits), component_id, the smallest id reachable over links.

    Documents link at `radius` or fewer differing bits; texts without words have fingerprint zero and link like any others. A
    null id is linked but never names a group, unless all ids of the group are null. Rows that repeat an id each get a row.
    Empty table: empty result."""
    rows = cut(fingerprints(docs, id_col, text_col, n))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    roots = components(link(prints.select("fp"), radius))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    best = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    linked = named.join(best.filter("prints > 1").drop("prints"), "root", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    out = attach(rows, cut(linked), ["fp"], "n", rows.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near_duplicates(), that of its smallest id; null ids lose to any other. Rows are told apart by
    id and text, so a null or repeated id takes no other row with it."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_digest(text_col).alias("sha"))
    found = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key")
    pairs = found.groupBy("key").agg(F.max(F.col("key") == F.col("component_id")).alias("_kept"), F.count("*").alias("_n"))
    return drop_copies(docs, cut(pairs.select(F.col("key.id").alias("_id"), F.col("key.sha").alias("_digest"), "_kept", "_n")), id_col, text_col)


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
