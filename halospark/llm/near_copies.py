"""Groups of near copies for the pipeline: searches for SimHash fingerprints within a wide radius in BK-trees, verified by exact Jaccard similarity.

Sets are five-word shingles, and rows link at a Jaccard similarity of 0.8 or more. At 0.8 the 64-bit SimHashes of two sets
differ in 10 bits on average and in more than RADIUS once in a million pairs. So wide a radius leaves no fingerprint block in
common, so shards are dealt by the sets' minima instead: each of BANDS keys mixes PER minima of hash functions, and sets at 0.8
have no key in common once in 300,000 pairs. Pairs of a shard within the radius, and of whose minima, kept as four bits each, AGREE
are alike (at 0.8, all but once in a million pairs), are verified on the shingles themselves.

A text of which over a fifth of the shingles are in no other text of a shard cannot have the similarity with any, as J is at
most the part that is shared. Such texts are taken out first, again and again as their leaving makes others' shingles rare. What is
left are mostly texts near the middle of their groups. Of these, a task builds a BK-tree of the fingerprints of each shard and searches it with every
member, those with the fewest lone shingles first. What finds a likely copy in the tree is a pair with it; only what finds none goes into the tree, which
so holds a few texts of each group and stays small. Shards of more than TREE members are cut in parts, each with a tree of its own that begins with
the shard's first member. Exact similarity decides on the pairs. A text that this doesn't connect with the largest group of each of its shards is then
looked for by its rarest shingles: in one order of all shingles, the first fifths and one more of two similar texts have one in common. So a group of n
near copies costs about n pairs, those that nothing links meet only texts that share what is rare in them, and no link is left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, attach, components, cut, discard, drop_copies, text_digest
from .decontaminate import _Hashes, _shingle_hashes, words_of
from .simhash import BKTree

WORDS, JACCARD, RADIUS = 5, 0.8, 24
BANDS, PER = 24, 4
#: Of BANDS * PER minima.
AGREE = 60
#: Texts of one shingle that a task looks from, about.
TILE = 2000
#: Members of a shard, or of a part of it, that one tree is searched with, about; pairs that a member comes out in, nearest first.
TREE, FEW = 2000, 4
#: How often texts with too many lone shingles are taken out.
PRUNES = 3
LONGS = BANDS * PER // 16
_MULT = np.random.default_rng(5).integers(0, 2**63, BANDS * PER, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(6).integers(0, 2**63, BANDS * PER, np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLES = int("1" * BANDS * PER, 16)
_SHIFT = np.arange(63, -1, -1, dtype=np.uint64)


def _words(text: str | None) -> list[str]:
    """words_of(), or, in a text without any, what white space separates."""
    return words_of(text) or (text or "").split()


def sketch(text: str | None, of: dict) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(SimHash, keys, minima's four bits in longs, size) of the set of shingles; a text without words has zeros."""
    words = _words(text)
    if not words:
        return 0, np.zeros(BANDS, np.uint64), np.zeros(LONGS, np.uint64), 0
    h = np.unique(_shingle_hashes(words, WORDS, of))
    ones, least = np.zeros(64, np.int64), np.full(BANDS * PER, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):  # bounded memory for any text
        part = h[k : k + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        np.minimum(least, (part[None, :] * _MULT[:, None]).min(axis=1), out=least)
    mixed = (least ^ least >> np.uint64(31)) * _MIX
    keys = (mixed ^ mixed >> np.uint64(29)).reshape(BANDS, PER).sum(axis=1, dtype=np.uint64)
    bits = ((mixed >> np.uint64(60)).reshape(LONGS, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return int(((2 * ones > len(h)).astype(np.uint64) << _SHIFT).sum(dtype=np.uint64)), keys, bits, len(h)


def _near() -> F.Column:
    """Whether fp, sig, size and fp_b, sig_b, size_b may be of similar texts."""
    differ = [f"(sig[{k}] ^ sig_b[{k}])" for k in range(LONGS)]
    ones = " + ".join(f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & 1229782938247303441L)" for d in differ)  # a one for each four bits
    return F.expr(f"least(size, size_b) >= {JACCARD} * greatest(size, size_b) - 1e-9 AND bit_count(fp ^ fp_b) <= {RADIUS} AND {ones} <= {BANDS * PER - AGREE}")


class _Tree:
    """A BK-tree of the fingerprints of texts of which no two are likely to be similar, by _near()'s rule."""

    def __init__(self):
        self.tree, self.texts = BKTree(), {}

    def meet(self, node: int, fp: int, sig: int, size: int) -> list[int]:
        """The FEW nearest texts of the tree that may be similar; if there are none, the text goes into it."""
        found = []
        for k in self.tree.within(fp, RADIUS):
            v = self.tree.values[k]
            for other, its_sig, its_size in self.texts[v]:
                d = sig ^ its_sig
                if min(size, its_size) >= JACCARD * max(size, its_size) - 1e-9 and ((d | d >> 1 | d >> 2 | d >> 3) & _NIBBLES).bit_count() <= BANDS * PER - AGREE:
                    found.append(((v ^ fp).bit_count(), other))
        if not found:
            if fp not in self.texts:
                self.tree.add(fp)
            self.texts.setdefault(fp, []).append((node, sig, size))
        return [other for _, other in sorted(found)[:FEW]]


def _by_trees(shared: DataFrame, sketches: DataFrame, tree: int = TREE) -> DataFrame:
    """(a, b), each once: pairs that searches in the BK-trees of the shards find; shared: (node, key, lone), a row for each shard of a node.

    A shard of more than `tree` members is dealt by node to parts of about so many. Its first member is in each, so parts of one group are linked."""
    firsts = cut(shared.groupBy("key").agg(F.min(F.struct("lone", "node")).alias("l"), F.count("*").alias("many")).select("key", F.col("l.node").alias("first"), "many"))
    rows = attach(shared, firsts, ["key"], "many", shared.count()).withColumn("parts", F.ceil(F.col("many") / tree).cast("int"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    rows = rows.join(sketches, "node").select("key", "part", "node", "fp", "sig", "size", (F.col("node") != F.col("first")).alias("later"), "lone")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "later", "lone", "node").select("key", "part", "node", "fp", "sig", "size")

    def search(batches):
        at, held = None, None
        for b in batches:
            key, part, node, fp, sig, size = (b.column(k) for k in range(6))
            sigs = sig.flatten().to_numpy().astype("<i8").tobytes()
            pairs = []
            fps = fp.to_numpy().view(np.uint64).tolist()
            for k, (of, n, f, m) in enumerate(zip(zip(key.to_pylist(), part.to_pylist()), node.to_pylist(), fps, size.to_pylist())):
                if of != at:
                    at, held = of, _Tree()
                s = int.from_bytes(sigs[8 * LONGS * k : 8 * LONGS * (k + 1)], "little")
                pairs += ((min(n, other), max(n, other)) for other in held.meet(n, f, s, m))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

    out = cut(rows.mapInArrow(search, "a long, b long").distinct())
    discard(firsts)
    return out


def _similar() -> F.Column:
    """Whether set_a and set_b, arrays of the shingles' hashes, have the similarity asked for; two empty ones have."""
    shared, both = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return F.when(F.least(F.size("set_a"), F.size("set_b")) < JACCARD * F.greatest(F.size("set_a"), F.size("set_b")) - 1e-9, False).otherwise(shared >= JACCARD * (both - shared) - 1e-9)


def _sketches(texts: DataFrame) -> DataFrame:
    def run(batches):
        of = _Hashes()
        for b in batches:
            got = [sketch(t.as_py(), of) for t in b.column(1)]
            fps = np.array([g[0] for g in got], np.uint64).view(np.int64)
            keys = np.concatenate([g[1] for g in got]).view(np.int64) if got else np.zeros(0, np.int64)
            sigs = np.concatenate([g[2] for g in got]).view(np.int64) if got else np.zeros(0, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, n, dtype=np.int32)), pa.array(x)) for x, n in ((keys, BANDS), (sigs, LONGS))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *lists, pa.array([g[3] for g in got], pa.int32())], names=["sha", "fp", "keys", "sig", "size"])

    return texts.select("sha", "text").mapInArrow(run, "sha string, fp long, keys array<long>, sig array<long>, size int")


def _sets(held: DataFrame) -> DataFrame:
    """(node, set) of (node, text): the hashes of the shingles, sorted."""

    def run(batches):
        of = _Hashes()
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                sets = [np.unique(_shingle_hashes(w, WORDS, of)).view(np.int64) if (w := _words(t.as_py())) else np.zeros(0, np.int64) for t in part.column(1)]
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], names=["node", "set"])

    return held.select("node", "text").mapInArrow(run, "node long, set array<long>")


def _possible(sets: DataFrame) -> DataFrame:
    """(node, lone) of the rows (node, set) that may be similar to another: lone shingles are at most a part of 1 - JACCARD."""
    good, hashes = sets.select("node"), cut(sets.select("node", F.explode("set").alias("h"), F.size("set").alias("size")))
    written = [hashes]
    for _ in range(PRUNES):
        once = hashes.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("size").alias("size")).filter("c = 1")
        lone = cut(once.groupBy("node").agg(F.count("*").alias("lone"), F.min("size").alias("size")))
        written.append(lone)
        bad = lone.filter(F.col("size") - F.col("lone") < F.lit(JACCARD) * F.col("size") - 1e-9)
        if bad.isEmpty():
            break
        good, hashes = good.join(bad, "node", "left_anti"), hashes.join(bad, "node", "left_anti")
    out = cut(good.join(lone.select("node", "lone"), "node", "left").fillna(0, ["lone"]))
    discard(*written)
    return out


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that _near() lets pass and whose sets have the similarity asked for.

    Sets (node, set) are joined to both sides by shuffles. A set that many pairs ask for goes out in as many copies as there are thousandths of
    the pairs in those, each to a task of its own: sets of any length and number are never broadcast."""
    two = sketches.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("fp", "sig", "size")))
    near = cut(pairs.join(sketches.withColumnRenamed("node", "a"), "a").join(two, "b").filter(_near()).select("a", "b"))
    rows, least = near, max(1, near.count() // HOT_SHARE)
    for side, other in ("ab", "ba"):
        copies = near.groupBy(side).agg(F.ceil(F.count("*") / least).cast("int").alias("_copies"))
        hot = F.broadcast(copies.filter("_copies > 1"))  # HOT_SHARE ids and numbers at most
        asked = rows.join(hot, side, "left").withColumn("_copy", F.coalesce(F.pmod(F.xxhash64(other), F.col("_copies")), F.lit(0)).cast("int")).drop("_copies")
        given = sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")).join(copies, side)
        rows = asked.join(given.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies").hint("merge"), [side, "_copy"]).drop("_copy")
    out = cut(rows.filter(_similar()).select("a", "b"))
    discard(near)
    return out


def _rare(own: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): each of own (node) with those of sets (node, root, set) of other roots of which one of the rarest shingles is one of its
    rarest, and which _near() lets pass. In one order for all, the first fifths and one more of two similar sets have a shingle in common.
    The filter is part of the join, so texts of one shingle are compared where they meet and only what may be similar comes out.

    Of the first shingle that two texts have in common, what follows it in either must be enough for the similarity, as none before it is
    shared. So a pair is left out at a shingle that fails this; a similar pair comes out at its first common shingle at least."""
    hashes = cut(sets.select("node", "root", F.explode("set").alias("h")))
    often = hashes.groupBy("h").agg(F.count("*").alias("df"))
    w = Window.partitionBy("node")
    ranked = hashes.join(often, "h").withColumn("rank", F.row_number().over(w.orderBy("df", "h"))).withColumn("size", F.count("*").over(w))
    first = cut(ranked.filter(F.col("rank") <= F.floor((1 - JACCARD) * F.col("size") + 1e-9) + 1).filter("df > 1").select("h", "node", "root", (F.col("size") - F.col("rank") + 1).cast("int").alias("from_here"), F.ceil(F.col("df") / TILE).cast("int").alias("tiles")))
    # a shingle of many texts: those that look are dealt to tiles, each of which has all that they look at
    mine = first.join(own, "node", "left_semi").select("h", F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("from_here").alias("from_here_x"), F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    asked = first.join(mine.select("h").distinct(), "h", "left_semi")
    two = sketches.select(F.col("node").alias("x"), *(F.col(c).alias(f"{c}_b") for c in ("fp", "sig", "size")))
    there = asked.join(sketches, "node").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    reach = F.least("from_here", "from_here_x") * (1 + JACCARD) >= JACCARD * (F.col("size") + F.col("size_b")) - 1e-9
    met = mine.join(two, "x").join(there, ["h", "tile"]).filter((F.col("root") != F.col("root_x")) & reach & _near())
    out = cut(met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())
    discard(hashes, first)
    return out


def similar_groups(docs: DataFrame) -> DataFrame:
    """(sha, node, root) for each sha of docs (sha, text), a digest of the text: root is alike for texts linked over any number of links.

    Words are as in decontaminate.words_of(); fewer than five are one shingle, and texts without words all link."""
    rows = cut(_sketches(docs).withColumn("row", F.monotonically_increasing_id()))
    nodes = cut(rows.groupBy("sha").agg(F.min("row").alias("node")))
    one = cut(rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "sha", "fp", "keys", "sig", "size"))
    discard(rows)
    dealt = one.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    total = nodes.count()
    shards = lambda rows: cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    sizes = shards(dealt)
    met = cut(attach(dealt, sizes, ["key"], "n", total).filter("n is not null").select("node", "key"))
    members = one.join(met.select("node").distinct(), "node", "left_semi")
    held = docs.select("sha", "text").join(members.select("sha", "node"), "sha").dropDuplicates(["sha"])
    sets = cut(_sets(held))
    possible = _possible(sets)
    kept = met.join(possible, "node")
    again = shards(kept)
    shared = cut(attach(kept, again, ["key"], "n", total).filter("n is not null").select("node", "key", "lone"))
    in_shards = shared.select("node").distinct()
    whole, sketches = cut(sets.join(in_shards, "node", "left_semi")), cut(members.select("node", "fp", "sig", "size").join(in_shards, "node", "left_semi"))
    discard(sizes, again, met, sets, possible, one)
    pairs = _by_trees(shared, sketches)
    links = _verified(pairs, sketches, whole)
    roots = cut(components(links))
    grouped = cut(shared.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = grouped.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("largest"), F.count("*").alias("roots"))
    apart = grouped.join(groups.filter("roots > 1").select("key", F.col("largest.root").alias("main")), "key").filter("root <> main").select("node").distinct()
    rest = _rare(cut(apart), whole.join(grouped.select("node", "root").distinct(), "node"), sketches)
    more = _verified(rest.join(pairs, ["a", "b"], "left_anti"), sketches, whole)
    out = cut(nodes.join(components(links.unionByName(more)), "node", "left").select("sha", "node", F.coalesce("root", "node").alias("root")))
    discard(nodes, shared, whole, sketches, pairs, links, roots, grouped, rest, more)
    return out


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar_groups() (five-word shingles, Jaccard similarity 0.8), that of its smallest id; null ids
    lose to any other. Rows are told apart by id and text, so a null or repeated id takes no other row with it."""
    rows = docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("sha"), F.col(text_col).alias("text"))
    groups = similar_groups(rows.select("sha", "text"))
    counts = cut(rows.groupBy("sha", "id").agg(F.count("*").alias("n")).join(groups, "sha"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "sha")
    best = cut(counts.groupBy("root").agg(F.min(first).alias("best"), F.count("*").alias("m"), F.max("n").alias("most")).filter("m > 1 or most > 1"))
    pairs = counts.join(best, "root").select(F.col("id").alias("_id"), F.col("sha").alias("_digest"), (first == F.col("best")).alias("_kept"), F.col("n").alias("_n"))
    return drop_copies(docs, cut(pairs), id_col, text_col)
