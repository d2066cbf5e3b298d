"""Toxicity by a logistic regression whose scores are held still under swaps of identity terms.

Features are the presence of words and of their first letters. Those that tell the labels apart in a bounded sample of
labelled rows are used. The loss is the log loss plus, for each labelled sentence that names a group, the squared change of
its log odds when the group is swapped for another; so a neutral mention does not raise the score."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, least_hashed, table

#: Labelled rows of each label that are learnt from (those with the smallest hashes of their ids), features used, threshold.
SAMPLE, FEATURES, THRESHOLD = 8000, 4000, 0.7
FOLDS, HELD = 3, 1
PENALTY, RIDGE, STEPS = 1.0, 2e-5, 400
PREFIXES = (4, 5, 6)
#: Identity terms, by group (fixed values); a term is swapped for the next of its group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("gay", "lesbian", "straight", "bisexual", "transgender"), ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frau", "mann"), ("frauen", "männer"), ("juden", "christen", "muslime"), ("femme", "homme"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("mujer", "hombre"), ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)
SWAP = {t: g[(k + 1) % len(g)] for g in IDENTITY for k, t in enumerate(g)}
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]


def swapped(words: set[str]) -> set[str] | None:
    """The words with identity terms swapped; None if there are none."""
    return None if words.isdisjoint(SWAP) else {SWAP.get(w, w) for w in words}


class Classifier:
    """weights: feature -> weight."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple] = {}

    def hits(self, word: str) -> tuple:
        return tuple(f for f in features_of(word) if f in self.weights)

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        known = self.known
        for w in words_of(text):
            h = known.get(w)
            if h is None:
                if len(known) > 300_000:
                    known.clear()
                h = known[w] = self.hits(w)
            if h:
                found.update(h)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def choose(counts: DataFrame, positives: int, negatives: int, most: int = FEATURES) -> list[str]:
    """The features of (feature, pos, neg) with the strongest likelihood ratio, `most` at most, that are in three rows at least."""
    p, n = F.col("pos"), F.col("neg")
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    share = (p + n) / F.lit(float(positives + negatives))
    g2 = 2 * (term(p, share * positives) + term(n, share * negatives) + term(positives - p, (1 - share) * positives) + term(negatives - n, (1 - share) * negatives))
    rows = counts.filter("pos + neg >= 3").withColumn("g2", g2).filter("g2 > 8").orderBy(F.desc("g2"), "feature").limit(most).collect()  # `most` rows
    return [r["feature"] for r in rows]


def fit(rows: list[tuple[list[int], list[int] | None, int, float]], names: list[str], penalty: float = PENALTY) -> Classifier:
    """rows: (features, features after a swap or None, label, weight)."""
    m, d = len(rows), len(names)
    if not m or len({r[2] for r in rows}) < 2:
        share = sum(r[2] for r in rows) / m if m else 0.0
        return Classifier({}, float(np.log((share + 0.01) / (1.01 - share))))
    y, weight = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])
    weight = weight / weight.sum()

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)

    at, ids = flat([r[0] for r in rows])
    pairs = [(a, b, w) for (a, b, _, _), w in zip(rows, weight) if b is not None]
    diff_at, diff_ids = flat([np.concatenate([a, b]) for a, b, _ in pairs])
    sign = np.concatenate([[1.0] * len(a) + [-1.0] * len(b) for a, b, _ in pairs]) if pairs else np.zeros(0)
    pair_weight = np.array([w for *_, w in pairs])
    share = float(weight @ y)
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    mw = vw = np.zeros(d)
    mb = vb = 0.0
    for step in range(1, STEPS + 1):  # Adam on all rows
        z = np.bincount(at, w[ids], m) + b
        err = (1 / (1 + np.exp(-z)) - y) * weight
        grad = np.bincount(ids, err[at], d) + RIDGE * w
        if pairs:
            change = np.bincount(diff_at, sign * w[diff_ids], len(pairs))
            grad += 2 * penalty * np.bincount(diff_ids, (pair_weight * change)[diff_at] * sign, d)
        mw, vw = 0.9 * mw + 0.1 * grad, 0.999 * vw + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * err.sum(), 0.999 * vb + 0.001 * err.sum() ** 2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.05 * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-8)
        b -= 0.05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return Classifier({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-9}, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Learns from the rows of docs that labels name and that aren't held out, SAMPLE of each label at most.

    Null labels and ids are left out; an id labelled twice is toxic if either label says so, and of the rows that repeat an id one
    text is learnt from, the least. Without rows of both labels every text scores about the share of toxic rows. FEATURES features are used
    at most, those with the strongest likelihood ratio."""
    kind = docs.schema[id_col].dataType.simpleString()
    use = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    use = cut(use.groupBy(F.col(id_col).cast(kind).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    n = dict(use.groupBy("y").count().collect())
    picked = [least_hashed(use.filter(F.col("y") == y), F.xxhash64("id"), SAMPLE, n.get(y, 0), "id") for y in (0, 1)]
    ids = F.broadcast(cut(picked[0].unionByName(picked[1])))  # 2 * SAMPLE rows at most
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id")
    sample = cut(labelled.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y"))

    def count(batches):
        counts = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[y].update({f for w in words_of(t) for f in features_of(w)})
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield from made(counts)
                    counts = (Counter(), Counter())
        yield from made(counts)

    def made(counts):
        names = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(names), 100_000):
            part = names[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[y][f] for f in part], pa.int64()) for y in (1, 0))], names=["feature", "pos", "neg"])

    found = dict(sample.groupBy("y").count().collect())
    counts = sample.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    names = choose(counts, found.get(1, 0), found.get(0, 0))
    place = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def encode(batches):
        of = place.value
        code = lambda words: sorted({of[f] for w in words for f in features_of(w) if f in of})
        for b in batches:
            words = [words_of(t) for t in b.column(0).to_pylist()]
            other = [swapped(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([code(w) for w in words], pa.list_(pa.int32())), pa.array([None if o is None else code(o) for o in other], pa.list_(pa.int32())), b.column(1)], names=["x", "swapped", "y"])

    coded = sample.mapInArrow(encode, "x array<int>, swapped array<int>, y int").toArrow()  # 2 * SAMPLE rows of at most FEATURES numbers
    rows = [(x.values.to_numpy(), None if s.values is None else s.values.to_numpy(), y, n[y] / found[y]) for b in coded.to_batches() for x, s, y in zip(b.column(0), b.column(1), b.column(2).to_pylist())]
    return fit(rows, names)


def held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == HELD


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: id, held_out, score, predicted (1 if score >= threshold).

    Held-out rows, those whose crc32 of the id's text is HELD modulo FOLDS, give no labels. Only the text is an input of the
    score. Null and empty texts score as texts without any feature; rows that repeat an id each get a row; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def run(batches):
        m = model.value
        for b in batches:
            scores = [m.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64())], names=["id", "held_out", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out")).mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    names = docs.columns

    def run(batches):
        m = model.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([m.score(t.as_py()) < THRESHOLD for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(names)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
