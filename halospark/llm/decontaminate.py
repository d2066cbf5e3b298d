"""Benchmark decontamination by size-partitioned MinHash containment search.

Sets are word shingles. Items fall in size classes (w/2, w], w a power of two. For each class, documents are cut in windows of
2w shingles every w shingles, so that a passage of an item lies in one window and no set it is compared with is larger than
2w. Containment of at least t in a set of at most 2w then means a Jaccard similarity of at least
j = t q / (q + 2w - t q), and the class takes as many MinHash functions as make (1 - j)^k less than MISS. A window and an item
that agree on any function are a candidate, and candidates are verified by exact containment in the whole document. A window
can only agree with an item if it holds one of the item's minimal shingles, so others need no signature."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_digest

WORDS, CONTAINMENT, MISS = 5, 0.8, 1e-6
#: Items broadcast at once, and their characters; more are searched in blocks, each over all documents.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 40_000_000
_MULT, _FINAL, _BITS = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD), 22
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _shingles(words: list[str], n: int) -> list[str]:
    """Distinct shingles; fewer words than n: the whole sequence; no words: none."""
    if not words:
        return []
    return list(dict.fromkeys(" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))))


def _shingle_hashes(words: list[str], n: int, of: dict) -> np.ndarray:
    h = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    m, out = max(1, len(h) - n + 1), np.zeros(max(1, len(h) - n + 1), np.uint64)
    for k in range(min(n, len(h))):
        out = out * np.uint64(_MULT) + h[k : k + m]
    out ^= out >> np.uint64(33)
    out *= _FINAL
    return out ^ out >> np.uint64(29)


class ItemIndex:
    """MinHash tables of the items, by size class. items: (id, text)."""

    def __init__(self, items, n: int, t: float):
        self.n, self.t, of = n, t, _Hashes()
        self.ids, self.sets, self.classes = [], [], {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            k, s = len(self.ids), frozenset(_shingles(words, n))
            self.ids.append(item)
            self.sets.append(s)
            w = 1 << max(0, math.ceil(math.log2(len(s))))
            if w not in self.classes:
                q = w // 2 + 1
                j = t * q / (q + 2 * w - t * q)
                size = max(8, math.ceil(math.log(MISS) / math.log(1 - j)))
                rng = np.random.default_rng(w)
                self.classes[w] = (rng.integers(0, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1), {})
            mult, at = self.classes[w]
            least = self.minima(np.unique(_shingle_hashes(words, n, of)), mult)
            for f, v in enumerate(least.tolist()):
                at.setdefault((f, v), []).append(k)
        # the shingles that are minimal for some function of some item: x, as min(x * mult) = v and mult is odd
        hits = {w: np.unique(np.array([v * pow(int(mult[f]), -1, 2**64) % 2**64 for f, v in at], np.uint64)) for w, (mult, at) in self.classes.items()}
        self.hits = hits
        self.bits = np.zeros(1 << _BITS, bool)
        for h in hits.values():
            self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def minima(h: np.ndarray, mult: np.ndarray) -> np.ndarray:
        return (h[None, :] * mult[:, None]).min(axis=1)

    def search(self, text: str | None, of: dict) -> list[tuple[int, float, int, int]]:
        """(item's number, containment, shared shingles, item's shingles) of the items that text contains."""
        words = words_of(text)
        if not words:
            return []
        h = _shingle_hashes(words, self.n, of)
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        found: set[int] = set()
        for w, (mult, tables) in self.classes.items():
            own, hits = h[at], self.hits[w]
            place = np.minimum(np.searchsorted(hits, own), len(hits) - 1)
            here = at[hits[place] == own]
            last = max(0, -(-len(h) // w) - 2)  # windows start at 0, w, ... last * w
            for s in np.unique(np.concatenate([np.clip(here // w, 0, last), np.clip(here // w - 1, 0, last)])).tolist() if len(here) else ():
                for fv in enumerate(self.minima(h[s * w : (s + 2) * w], mult).tolist()):
                    if fv in tables:
                        found.update(tables[fv])
        if not found:
            return []
        own = set(_shingles(words, self.n))
        out = []
        for k in sorted(found):
            shared = len(self.sets[k] & own)
            if shared >= self.t * len(self.sets[k]):
                out.append((k, shared / len(self.sets[k]), shared, len(self.sets[k])))
        return out


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WORDS, t: float = CONTAINMENT) -> DataFrame:
    """(id, item_id, containment, shared, item_shingles): each row of docs with each item of which it holds a share t of the shingles.

    Words are lower-cased runs of letters and digits, so punctuation and white space don't matter. Items of fewer than n words
    have one shingle, all their words, which only a document of just these words has. Null or empty texts, of items or
    documents, are in no pair. Rows that repeat an id are each searched. Other columns are ignored. No item may have a null id
    and an equal text as another: ids name the items in the result and may repeat. Empty tables give an empty result."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    n_items, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in part.collect()], n, t))

        def search(batches, index=index):
            of = _Hashes()
            for b in batches:
                ix, got, at = index.value, [], []
                for k in range(b.num_rows):
                    pairs = ix.search(b.column(1)[k].as_py(), of)
                    got += pairs
                    at += [k] * len(pairs)
                if got:
                    ids = b.column(0).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([ix.ids[g[0]] for g in got]), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())],
                        names=["id", "item", "containment", "shared", "item_shingles"],
                    )

        found = rows.mapInArrow(search, f"id {id_kind}, item {item_kind}, containment double, shared long, item_shingles long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_id)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, decided by each row's text: ids may be null or repeat."""
    texts = docs.select(text_digest(text_col).alias("_digest"), F.col(text_col).alias("text"))
    gone = cut(contained_items(texts, items, "_digest").select(F.col("_digest")).distinct())
    rows = docs.select(F.struct("*").alias("row"), text_digest(text_col).alias("sha"))
    return rows.join(gone, rows["sha"] == gone["_digest"], "left_anti").select("row.*")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLED = """{t}_w AS (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table} WHERE text IS NOT NULL),
{t} AS (SELECT DISTINCT {id}, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM {t}_w WHERE len(w) > 0)"""
SQL = f"""
WITH {_SHINGLED.format(t="d", id="doc_id", table="documents")},
{_SHINGLED.format(t="i", id="item_id", table="benchmark")},
n AS (SELECT item_id, CAST(count(*) AS BIGINT) AS item_shingles FROM i GROUP BY 1),
x AS (SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS shared FROM d JOIN i USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(shared AS DOUBLE) / item_shingles AS containment, shared, item_shingles
FROM x JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles
"""
