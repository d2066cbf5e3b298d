"""Language-model scores by logistic context mixing over bits.

Frequent words, an escape and a text's end have a binary code, and a text is the bits of its words' codes. Predictors are the
code alone and hashed contexts across words: the last word, and the last two words' endings. A mixer adds what
they say with weights picked by a gate, and a table refines the result (context_mixing.py). While a text is scored, its copy
of the weights goes on learning from what has been read of it.

An escaped word is one that the text has escaped before, as often as it did, or a new one: (m or NOVEL * p) / (k + NOVEL)
after k escapes, m of them this word. p is a share of the rarer training words, discounted, and what that leaves goes to
words that training lacks; these are spelt, by bit predictors over the bytes of the word so far that learn from the rarer
training words, each once.

Learning is on the training rows only. Their words are all counted, and all their bits in tables summed block by block, so what is
gathered grows with the corpus. The tables grow with the training tokens up to SLOT_BITS for a predictor, and HEAD words have
codes, which bounds what is broadcast: a byte for each slot. Weights and refinement are learnt on one training row of TUNE, with
codes and tables that lack these rows, in shards by a hash whose results are averaged; the tables then get all rows. So a document's score
depends on no other scored row and not on the partitions."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, table
from .context_mixing import BLOCK, Events, Mixer, SpellingContexts, WordContexts, Words, groups, inputs, online, pieces, ranges

#: Words with a code; bits of a slot's number at least and at most; one in TUNE rows sets weights; shards at least and at most.
HEAD, SLOT_BITS, TUNE, SHARDS = 131_072, (16, 21), 8, (1, 256)
FOLDS, SMOOTH, NOVEL = 10, 0.1, 50.0
#: The step of a text's own weights and what holds it, and where in a text they learn: after 32 words and then 1.5 times as many each.
OWN_RATE, OWN_CALM = 2.0, 50.0
TURNS = np.array([int(32 * 1.5**k) for k in range(40)])
#: Bytes of the texts that are scored together, whose bits are counted together, and whose words are. No result depends on them.
TOGETHER, BITS_OF, COUNTED = 98_304, 98_304, 4_000_000


def tokens_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Model:
    """Contexts, inputs by slot, and the mixer."""

    def __init__(self, contexts, inputs_by_slot: np.ndarray, mixer: Mixer):
        self.contexts, self.inputs, self.mixer, self.settled = contexts, inputs_by_slot, mixer, mixer.settled()

    def spell(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word, its bits one after the other; for SpellingContexts."""
        out = [np.zeros(0)]
        for e in self.contexts.stream(words):
            x, gate = self.mixer.look(self.inputs, e)
            z = self.mixer.mixed(x, gate)
            p = self.mixer.likelihood(z, self.mixer.odds_to_p(z), e.bits, e.place, self.settled)
            out.append(np.add.reduceat(np.log10(p.astype(float)), e.first))
        return np.concatenate(out)

    def follow(self, ids: np.ndarray, contexts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of the codes of each of the pieces, given one after the other; for WordContexts."""
        if not len(ids):
            return np.zeros(len(sizes))
        turn = np.searchsorted(TURNS, ranges(sizes), side="right").astype(np.int8)
        piece, order = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.argsort(turn, kind="stable")
        piece = piece[order]
        e: Events = self.contexts.events(ids[order], contexts[:, order])
        x, gate = self.mixer.look(self.inputs, e)
        bounds = np.append(e.first, len(e.bits))
        ends = bounds[np.cumsum(np.bincount(turn))]
        p = online(self.mixer, self.settled, x, e, gate, np.repeat(piece, np.diff(bounds)), ends.tolist(), OWN_RATE, OWN_CALM)
        return np.bincount(piece, np.log10(np.multiply.reduceat(p.astype(float), e.first)), len(sizes))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(token binary, n, others, all): the words of (text, held, tune), with their counts in the training rows, in those that
    aren't tuning rows, and in all rows."""

    def made(texts, kind):
        words = Words(b" ".join(texts))
        _, one, n = np.unique(words.hashes, return_index=True, return_counts=True)
        s, sizes = words.starts[one], words.ends[one] - words.starts[one]
        ends = np.cumsum(sizes)
        flat = words.data[np.repeat(s - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        tokens = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])
        counts = [n if k == kind else np.zeros(len(n), np.int64) for k in range(3)]
        for k in range(0, len(one), 50_000):
            yield pa.RecordBatch.from_arrays([tokens.slice(k, 50_000), *(pa.array(c[k : k + 50_000]) for c in counts)], names=["token", "held", "tune", "others"])

    def run(batches):
        texts, sizes = [[], [], []], [0, 0, 0]
        for b in batches:
            for t, held, tune in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                kind = 0 if held else 1 if tune else 2
                for piece, *_ in pieces(t.as_py()):
                    texts[kind].append(piece)
                    sizes[kind] += len(piece)
                    if sizes[kind] > COUNTED:
                        yield from made(texts[kind], kind)
                        texts[kind], sizes[kind] = [], 0
        for kind in range(3):
            yield from made(texts[kind], kind)

    counted = rows.select("text", "held", "tune").mapInArrow(run, "token binary, held long, tune long, others long")
    n = F.col("tune") + F.col("others")
    return counted.groupBy("token").agg(F.sum(n).alias("n"), F.sum("others").alias("others"), F.sum(n + F.col("held")).alias("all"))


def slot_bits(tokens: int) -> int:
    """About eight slots for each training token."""
    return int(np.clip(max(tokens, 1).bit_length() + 3, *SLOT_BITS))


def _packed(counts: np.ndarray) -> bytes:
    """A byte for each count where that is enough, else four, compressed."""
    return zlib.compress(counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    return np.frombuffer(data, np.uint8 if len(data) == 2 * BLOCK else np.uint32)


def _bit_counts(rows: DataFrame, shared) -> DataFrame:
    """(block, others, tuning): counts of zeros and ones, side by side, of BLOCK slots, each row by one task; rows: (item, tune)."""

    def run(batches):
        contexts = shared.value
        size = -(-int(contexts.offsets[-1]) // BLOCK) * BLOCK
        seen = np.zeros((2, 2 * size), np.uint32)
        for b in batches:
            tune = np.array(b.column(1).to_pylist(), bool)
            for f in (0, 1):
                for e in contexts.stream((x.as_py() for x in b.column(0).filter(pa.array(tune == bool(f)))), BITS_OF):
                    for s in e.slots:
                        at = s.astype(np.int64)
                        at *= 2
                        at += e.bits
                        np.add.at(seen[f], at, np.uint32(1))
        full = np.flatnonzero(seen.reshape(2, -1, 2 * BLOCK).any(axis=(0, 2)))
        for k in range(0, len(full), 32):
            part = full[k : k + 32].tolist()
            blocks = [[_packed(seen[f, j * 2 * BLOCK : (j + 1) * 2 * BLOCK]) for j in part] for f in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in blocks)], names=["block", "others", "tuning"])

    return rows.select("item", "tune").mapInArrow(run, "block int, others binary, tuning binary")


def _inputs(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """inputs() by slot of all rows, and without the tuning ones."""

    def run(batches):
        at, total = None, np.zeros((2, 2 * BLOCK))

        def made():
            others, all_rows = total[0], total.sum(axis=0)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([inputs(t[::2], t[1::2]).tobytes()], pa.binary()) for t in (all_rows, others))], names=["block", "all_rows", "others"])

        for b in batches:
            for k, others, tuning in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if k != at:
                    if at is not None:
                        yield made()
                    at = k
                    total[:] = 0
                total[0] += _unpacked(others.as_py())
                total[1] += _unpacked(tuning.as_py())
        if at is not None:
            yield made()

    blocks = -(-size // BLOCK)
    summed = counts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, all_rows binary, others binary")
    out = np.zeros((2, blocks * BLOCK), np.int8)
    for b in summed.toArrow().to_batches():  # 2 bytes for each slot, whose number is bounded
        for k, *both in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            for f in (0, 1):
                out[f, k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(both[f].as_py(), np.int8)
    return out[0], out[1]


def train(rows: DataFrame, contexts, rows_per_shard: int) -> Model:
    """The model of rows (item, tune, h); h: a hash of the row, by which tuning rows are dealt and ordered."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(contexts)
    full, others = _inputs(_bit_counts(rows, shared), int(contexts.offsets[-1]))
    table_of = spark.sparkContext.broadcast(others)

    def learn(batches):
        items = ((s, i.as_py()) for b in batches for s, i in zip(b.column(0).to_pylist(), b.column(1)))
        for shard, group in itertools.groupby(items, key=lambda r: r[0]):
            mixer, seen = Mixer(contexts_of().predictors), 0
            for e in contexts_of().stream(i for _, i in group):
                x, gate = mixer.look(table_of.value, e)
                mixer.learn(x, e, gate)
                seen += len(gate)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(seen)]), *(pa.array([a.tobytes()], pa.binary()) for a in (mixer.w, mixer.ones, mixer.all))], names=["shard", "seen", "w", "ones", "all"])

    def contexts_of():
        return shared.value

    tuning = rows.filter("tune")
    shards = int(np.clip(tuning.count() // rows_per_shard, *SHARDS))
    dealt = tuning.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "item", "h").repartition(shards, "shard").sortWithinPartitions("shard", "h", "item")
    learnt = sorted(dealt.select("shard", "item").mapInArrow(learn, "shard int, seen double, w binary, ones binary, all binary").collect(), key=lambda r: r["shard"])  # SHARDS rows at most
    mixer, total = Mixer(contexts.predictors), sum(r["seen"] for r in learnt)
    if total:
        mixer.w = sum(np.frombuffer(r["w"], np.float32).reshape(mixer.w.shape) * (r["seen"] / total) for r in learnt).astype(np.float32)
        mixer.ones, mixer.all = (sum(np.frombuffer(r[c]) for r in learnt) for c in ("ones", "all"))
    shared.unpersist()
    table_of.unpersist()
    return Model(contexts, full, mixer)


def _frequency() -> F.Column:
    """A class of counts in the training rows without the tuning ones, 16 for each doubling; words that came once have the lowest."""
    return F.when(F.col("others") > 1, F.floor(F.log2("others") * 16).cast("int")).otherwise(-1)


def head_words(vocab: DataFrame, most: int = HEAD):
    """(the least class of head words, their tokens and counts): at most `most` words."""
    classes = sorted(((r["c"], r["many"]) for r in vocab.filter("others > 1").groupBy(_frequency().alias("c")).agg(F.count("*").alias("many")).collect()), reverse=True)  # about a thousand rows at most
    least, held = 10**6, 0
    for c, many in classes:
        if (held := held + many) > most:
            break
        least = c
    top = vocab.filter(_frequency() >= least).select("token", "n").toArrow().sort_by("token")  # `most` rows at most
    return least, top["token"].to_pylist(), np.array(top["n"].to_pylist(), float)


class Texts:
    """Scores texts but for the part of their rarer words: those need the vocabulary."""

    def __init__(self, model: Model, bases: np.ndarray, end_base: float):
        self.model, self.bases, self.end_base = model, np.append(bases, [0.0, end_base]), end_base

    def score(self, texts: list) -> list[tuple]:
        """(tokens, known head words, their and the end's base, log10 of the bits and of escapes met again, bytes, {rarer word: times})."""
        contexts, out = self.model.contexts, np.zeros((len(texts), 5))
        rarer: list[dict] = [{} for _ in texts]
        escapes = [0] * len(texts)
        for held in groups(texts, TOGETHER):
            ids, ctx, sizes, missed, where = contexts.gather(held)
            text = np.array([p[0] for p in held])
            of = np.repeat(text, sizes)
            for k, w in zip(text[where].tolist(), missed):
                m = rarer[k].get(w, 0)
                out[k, 3] += math.log10((m or NOVEL) / (escapes[k] + NOVEL))
                rarer[k][w] = m + 1
                escapes[k] += 1
            out[:, 0] += np.bincount(of, minlength=len(texts))
            out[:, 1] += np.bincount(of, ids < contexts.escape, len(texts))
            out[:, 2] += np.bincount(of, self.bases[ids], len(texts))
            out[:, 4] += np.bincount(text, [len(p[1].translate(None, b" \t\n\r\v\f")) for p in held], len(texts))
            out[:, 3] += np.bincount(text, self.model.follow(ids, ctx, sizes), len(texts))
        out[:, 4] += out[:, 0]
        return [(*map(int, x[:2]), x[2], x[3], int(x[4]), r) for x, r in zip(out.tolist(), rarer)]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose crc32 of the id's text is 0 modulo FOLDS are held out (a null id counts as an empty text); the model and base_score learn from
    the others. Null texts are empty: their one token is the end. Rows that repeat an id each get a row and each count. Without
    training rows every probability is the smoothing's or the untrained model's. An empty table gives an empty result. A text of more
    than WINDOW bytes (context_mixing.py) is read in pieces, each with weights of its own.
    n_bytes is that of the tokens and ends; bits_per_byte is -score in bits over it."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    crc = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumns({"held": crc % FOLDS == 0, "tune": F.floor(crc / FOLDS) % TUNE == 0, "h": F.xxhash64(F.col("id").cast("string"))})
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    vocab = cut(vocabulary(rows))
    ends = rows.select("held").filter("not held").count()
    words, n, once, twice = vocab.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    total, distinct = n + ends, words + (ends > 0)
    norm = math.log10(total + SMOOTH * (distinct + 1))
    least, head, counts = head_words(vocab)
    rare = vocab.filter(_frequency() < least)
    rest, kinds = n - int(counts.sum()), words - len(head)
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)

    # rarer words: a share of the training words, or spelt
    spelling = SpellingContexts(slot_bits(rest))
    spelt = cut(rare.filter("n > 0").select(F.col("token").alias("item"), F.xxhash64("token").alias("h")).withColumn("tune", F.pmod(F.floor(F.col("h") / 256), F.lit(TUNE)) == 0))
    speller = spark.sparkContext.broadcast(train(spelt, spelling, 20_000))

    def spell(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(speller.value.spell(part.column(0).to_pylist()), pa.float64())], names=["token", "n", "all", "value"])

    unknown = rare.filter("n = 0").select("token", "n", "all").mapInArrow(spell, "token binary, n long, all long, value double")
    left = math.log10(discount * kinds / rest) if rest else 0.0
    priced = rare.filter("n > 0").select("token", "n", "all").withColumn("value", F.log10((F.col("n") - F.lit(discount)) / F.lit(float(max(rest, 1))))).unionByName(unknown.withColumn("value", F.col("value") + F.lit(left)))
    priced = cut(priced.select("token", "all", (F.col("n") > 0).cast("int").alias("known"), F.log10(F.col("n") + F.lit(SMOOTH)).alias("base"), "value"))

    contexts = WordContexts(head, counts, rest, ends, slot_bits(total))
    training = rows.filter("not held").select(F.col("text").alias("item"), "tune", "h")
    trained = train(training, contexts, 500)
    bases = np.log10(counts + SMOOTH)[contexts.order]
    scorer = spark.sparkContext.broadcast(Texts(trained, bases, math.log10(ends + SMOOTH)))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                got = scorer.value.score(part.column(1).to_pylist())
                at = pa.array(np.cumsum([0, *(len(g[5]) for g in got)]), pa.int32())
                tails = [pa.ListArray.from_arrays(at, pa.array([y for g in got for y in x(g[5])], t)) for x, t in ((dict.keys, pa.binary()), (dict.values, pa.int64()))]
                cols = [pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *cols, *tails], names=["id", "held", "row", "n_tokens", "known", "base", "score", "n_bytes", "rarer", "times"])

    found = cut(rows.select("id", "text", "held", "row").mapInArrow(run, f"id {kind}, held boolean, row long, n_tokens long, known long, base double, score double, n_bytes long, rarer array<binary>, times array<long>"))
    met = found.select("row", F.explode(F.arrays_zip("rarer", "times")).alias("t")).select("row", F.col("t.rarer").alias("token"), F.col("t.times").alias("times"))
    seen = rare.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    tails = attach(met, priced, ["token"], "all", seen).groupBy("row").agg(F.sum("value").alias("t_value"), F.sum(F.col("times") * F.col("base")).alias("t_base"), F.sum(F.col("times") * F.col("known")).alias("t_known"))
    found = found.drop("rarer", "times").join(tails, "row", "left").fillna(0, ["t_value", "t_base", "t_known"])
    score = F.col("score") + F.col("t_value")
    return found.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.col("t_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("t_base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), score.alias("score"), "n_bytes", (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
