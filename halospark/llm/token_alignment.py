"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often each pair of ids does so in the corpus.

Counting is external. A task encodes its documents, gathers (pair, document) records and, whenever it holds RUN_LINKS of them, sorts
them into a run, cut by a radix of the B id. Of each radix a run keeps a head (its pairs and their totals) and postings (their
documents), both in zstd frames of bounded size in a written table, not in files of one machine. Heads are merged FAN at a time
over a heap of frames, level by level, until each radix has one. Pairs stand in the order of their B id, so one pass over that last
head also gives each B id's highest count. Counts then stream down the same tree, to each run those of its own pairs, and a run
with all its radices adds them up over its own documents. A pair that stands in every document has one record in each run's
head, and no step holds more than FAN heads' frames, one run, or one radix of the distinct pairs."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE of this kind splits texts (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Radixes of the B id, links of a run, entries of a frame, runs merged at once, characters encoded together.
RADIX, RUN_LINKS, FRAME, FAN, TOGETHER = 64, 4_000_000, 65_536, 64, 1_000_000
#: A key is a pair and, in so many bits, a document of the run.
DOC_BITS = 22
_HEAD = "head array<binary>"


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """A tokenizer: encode() gives the ids of each text with a space before it, token[id] the bytes of an id."""

    def __init__(self, name: str, data: bytes):
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            of = lambda k: bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
            self.token = [b"" if model.is_control(k) or model.is_unknown(k) else of(k) for k in range(model.get_piece_size())]
            return
        import tiktoken

        spec, byte = json.loads(data), _byte_level()
        special = {t["id"] for t in spec.get("added_tokens", ())}
        ids = {bytes(byte[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if k not in special}
        made = [k for k, _ in enumerate(spec["model"]["merges"], 256)]
        merged = [ids[bytes(byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if merged != made or sorted(ids.values()) != list(range(len(ids))):
            raise ValueError(f"{name}: merges are not in the order of ids")
        bpe = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={})
        self.encode = lambda texts: [bpe.encode_ordinary(" " + t) for t in texts]
        self.token = [b""] * (max([*ids.values(), *special]) + 1)
        for t, k in ids.items():
            self.token[k] = t


@functools.lru_cache(maxsize=4)
def side(name: str, data: bytes) -> Side:
    return Side(name, data)


class Layout:
    """How a pair of ids is one number, in the order (radix of B, B, A)."""

    def __init__(self, n_a: int, n_b: int):
        self.a_bits, self.b_bits = max(1, n_a - 1).bit_length(), max(1, (n_b - 1) // RADIX).bit_length()
        if self.a_bits + self.b_bits + 6 + DOC_BITS > 63:
            raise ValueError("vocabularies are too large")

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((b % RADIX) << self.b_bits | b // RADIX) << self.a_bits) | a

    def radix(self, pair):
        return pair >> (self.a_bits + self.b_bits)

    def ids(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = pair >> self.a_bits
        return pair & ((1 << self.a_bits) - 1), (b & ((1 << self.b_bits) - 1)) * RADIX + (b >> self.b_bits)


def _pack(*columns: np.ndarray) -> bytes:
    """A zstd frame of columns of one length."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(frame: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(frame)
    n, at, out = len(raw) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def head_frames(pairs: np.ndarray, totals: np.ndarray) -> list[bytes]:
    """Frames of ascending pairs, kept as differences, and their totals."""
    cuts = range(0, len(pairs), FRAME)
    return [_pack(np.diff(pairs[k : k + FRAME], prepend=np.int64(0)), totals[k : k + FRAME]) for k in cuts]


def read_head(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, totals = _unpack(frame, np.int64, np.int64)
    return np.cumsum(step), totals


def merge_heads(heads: list[list[bytes]]):
    """Ascending (pairs, totals) blocks of several heads, equal pairs added up. A heap holds each head's current frame by its last pair:
    what is up to the least of these has come whole, so one frame of each head is held."""
    heap, frames = [], []
    for k, head in enumerate(heads):
        frames.append(iter(head))
        if (first := next(frames[k], None)) is not None:
            pairs, totals = read_head(first)
            heapq.heappush(heap, (int(pairs[-1]), k, pairs, totals))
    while heap:
        upto = heap[0][0]
        got, left = [], []
        for last, k, pairs, totals in heap:
            n = int(np.searchsorted(pairs, upto, "right"))
            got.append((pairs[:n], totals[:n]))
            if n < len(pairs):
                left.append((last, k, pairs[n:], totals[n:]))
            elif (more := next(frames[k], None)) is not None:
                pairs, totals = read_head(more)
                left.append((int(pairs[-1]), k, pairs, totals))
        heap = left
        heapq.heapify(heap)
        pairs, totals = (np.concatenate(c) for c in zip(*got))
        order = np.argsort(pairs, kind="stable")
        pairs, totals = pairs[order], totals[order]
        first = np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1))
        yield pairs[first], np.add.reduceat(totals, first)


def best_of(b: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Whether each pair's total is its B id's highest; equal B ids stand together."""
    first = np.flatnonzero(np.diff(b, prepend=b[0] - 1)) if len(b) else np.zeros(0, np.int64)
    return totals == np.repeat(np.maximum.reduceat(totals, first), np.diff(first, append=len(b))) if len(b) else np.zeros(0, bool)


class Aligner:
    """Aligns texts by two tokenizers and keeps what is needed to count their pairs."""

    def __init__(self, a: Side, b: Side, digest: bool):
        self.a, self.b, self.digest, self.layout = a, b, digest, Layout(len(a.token), len(b.token))
        self.size_a, self.size_b = (np.array([len(t) for t in s.token], np.int64) for s in (a, b))
        # as text: an id and what follows it, "," inside a group, "|" after its A ids, ";" after its B ids
        self.text = [f"{k}{c}" for k in range(len(a.token)) for c in ",|"] + [f"{k}{c}" for k in range(len(b.token)) for c in ",;"]
        self.clear()

    def clear(self) -> None:
        self.rows, self.keys, self.links = [], [], 0

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of both sides; none where either's bytes are not those of the text behind a space."""
        one, two = self.a.encode(texts), self.b.encode(texts)
        for k, t in enumerate(texts):
            want = b" " + t.encode("utf-8", "surrogatepass")
            if not t or b"".join(map(self.a.token.__getitem__, one[k])) != want or b"".join(map(self.b.token.__getitem__, two[k])) != want:
                one[k], two[k] = [], []
        return one, two

    def add(self, rows: list[int], texts: list[str]) -> list[tuple]:
        """(row, n_a, n_b, n_groups, groups) of texts, whose links are kept."""
        one, two = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in s], np.int64) for s in (one, two))
        a, b = (np.fromiter((i for x in s for i in x), np.int64, int(n.sum())) for s, n in ((one, n_a), (two, n_b)))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # over all texts: each has the same bytes on both sides
        at = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 1), bool)
        at[0, end_a], at[1, end_b] = True, True
        hit_a, hit_b = at[1, end_a], at[0, end_b]
        last_a, last_b = np.flatnonzero(hit_a), np.flatnonzero(hit_b)
        doc = np.repeat(np.arange(len(texts)), n_a)[last_a]
        base = len(self.rows)
        self.rows += rows
        self.keys.append(self.layout.pair(a[last_a], b[last_b]) << DOC_BITS | (doc + base))
        self.links += len(doc)
        groups = np.bincount(doc, minlength=len(texts))
        # a group's A ids come after all earlier groups' B ids, its B ids after its A ids
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[np.cumsum(hit_a) - hit_a]] = 2 * a + hit_a
        out[np.arange(len(b)) + np.concatenate([last_a + 1, [0]])[np.cumsum(hit_b) - hit_b]] = 2 * (b + len(self.a.token)) + hit_b
        ends = np.cumsum(n_a + n_b)
        done = []
        for k, r in enumerate(rows):
            text = "".join(map(self.text.__getitem__, out[ends[k] - n_a[k] - n_b[k] : ends[k]].tolist()))[:-1]
            done.append((r, int(n_a[k]), int(n_b[k]), int(groups[k]), hashlib.sha256(text.encode()).hexdigest() if self.digest and text else text))
        return done

    def run(self) -> list[tuple]:
        """(radix, head, postings) of what is kept, in order, and (-1, the documents' rows); then nothing is kept."""
        keys = np.sort(np.concatenate(self.keys)) if self.keys else np.zeros(0, np.int64)
        out = [(-1, [_pack(np.diff(np.array(self.rows, np.int64), prepend=np.int64(0)))], [])]
        self.clear()
        first = np.flatnonzero(np.diff(keys, prepend=np.int64(-1)))
        n, keys = np.diff(first, append=len(keys)), keys[first]  # a record for each pair and document
        pair, doc = keys >> DOC_BITS, (keys & ((1 << DOC_BITS) - 1)).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(self.layout.radix(pair), prepend=np.int64(-1)))
        for s, e in zip(cuts, np.append(cuts[1:], len(pair))):
            begins = np.diff(pair[s:e], prepend=np.int64(-1)) != 0
            at = np.flatnonzero(begins)
            posts = [_pack(begins[k : k + FRAME], doc[s + k : min(e, s + k + FRAME)], n[s + k : min(e, s + k + FRAME)].astype(np.uint32)) for k in range(0, e - s, FRAME)]
            out.append((int(self.layout.radix(pair[s])), head_frames(pair[s:e][at], np.add.reduceat(n[s:e], at)), posts))
        return out


def _encoded(docs: DataFrame, tokenizers: tuple[str, str], digest: bool) -> DataFrame:
    """The written table of (id, row, n_a, n_b, n_groups, groups) of docs (row, id, text) and (part, seq, radix, head, posts) of runs."""
    files = docs.sparkSession.sparkContext.broadcast([(p, Path(p).read_bytes()) for p in tokenizers])  # two vocabularies
    names = ["id", "row", "n_a", "n_b", "n_groups", "groups", "seq", "radix", "head", "posts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        aligner = Aligner(*(side(*f) for f in files.value), digest)

        def documents(ids, rows, texts):
            done = aligner.add(rows, texts)
            return pa.RecordBatch.from_arrays([ids, *(pa.array([d[k] for d in done], types[k]) for k in range(5)), *(pa.nulls(len(done), t) for t in types[5:])], names=names)

        def runs(seq, ids):
            got = aligner.run()
            return pa.RecordBatch.from_arrays([pa.nulls(len(got), ids), *(pa.nulls(len(got), t) for t in types[:5]), pa.array([seq] * len(got), types[5]), *(pa.array([g[k] for g in got], types[6 + k]) for k in range(3))], names=names)

        seq = 0
        for b in batches:
            ids, texts, since, held = b.column(1), [], 0, 0
            rows = b.column(0).to_pylist()
            for k in range(b.num_rows):
                texts.append(b.column(2)[k].as_py() or "")
                held += len(texts[-1])
                if held > TOGETHER or k + 1 == b.num_rows:
                    yield documents(ids.slice(since, k + 1 - since), rows[since : k + 1], texts)
                    texts, since, held = [], k + 1, 0
                    if aligner.links >= RUN_LINKS or len(aligner.rows) >= 1 << (DOC_BITS - 1):
                        yield runs(seq, ids.type)
                        seq += 1
        if aligner.rows:
            yield runs(seq, ids.type)

    made = docs.mapInArrow(run, f"id {kind}, row long, n_a long, n_b long, n_groups long, groups string, seq int, radix int, {_HEAD}, posts array<binary>")
    return cut(made.withColumn("part", F.spark_partition_id()))


def _merged(level: DataFrame) -> DataFrame:
    """The next level of heads (radix, run, head): FAN neighbouring runs' heads of a radix are one."""

    def merge(key, rows):
        pairs, totals, frames = [], [], []
        for p, t in merge_heads(rows.column("head").to_pylist()):
            pairs.append(p)
            totals.append(t)
            if sum(map(len, pairs)) >= FRAME:
                frames += head_frames(np.concatenate(pairs), np.concatenate(totals))
                pairs, totals = [], []
        frames += head_frames(np.concatenate(pairs), np.concatenate(totals)) if pairs else []
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "run": pa.array([key[1].as_py()], pa.int64()), "head": pa.array([frames], pa.list_(pa.binary()))})

    up = level.select("radix", F.expr(f"run div {FAN}").alias("run"), "head")
    return up.groupBy("radix", "run").applyInArrow(merge, f"radix int, run long, {_HEAD}")


def _topped(top: DataFrame, layout: Layout) -> DataFrame:
    """(radix, run, head, counts): the last heads with, in step with their frames, each pair's count and whether it is the B id's highest."""

    def run(batches):
        for b in batches:
            counts = []
            for head in b.column(2).to_pylist():
                pairs, totals = (np.concatenate(c) for c in zip(*map(read_head, head)))
                best = best_of(pairs >> layout.a_bits, totals)
                counts.append([_pack(totals[k : k + FRAME], best[k : k + FRAME]) for k in range(0, len(pairs), FRAME)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.list_(pa.binary()))], names=["radix", "run", "head", "counts"])

    return top.select("radix", "run", "head").mapInArrow(run, f"radix int, run long, {_HEAD}, counts array<binary>")


def _handed_down(level: DataFrame, above: DataFrame) -> DataFrame:
    """(radix, run, head, counts) of a level's heads, from those of the level above."""

    def hand(key, below, up):
        frames = zip(up.column("head").to_pylist()[0], up.column("counts").to_pylist()[0])
        parts = [(read_head(h)[0], *_unpack(c, np.int64, bool)) for h, c in frames]
        pairs, totals, best = (np.concatenate(p) for p in zip(*parts))
        counts = []
        for head in below.column("head").to_pylist():
            at = [np.searchsorted(pairs, read_head(h)[0]) for h in head]
            counts.append([_pack(totals[k], best[k]) for k in at])
        return pa.table({"radix": below.column("radix"), "run": below.column("run"), "head": below.column("head"), "counts": pa.array(counts, pa.list_(pa.binary()))})

    rows = level.select("radix", "run", "head", F.expr(f"run div {FAN}").alias("up"))
    over = above.select(F.col("radix"), F.col("run").alias("up"), "head", "counts")
    return rows.groupBy("radix", "up").cogroup(over.groupBy("radix", "up")).applyInArrow(hand, f"radix int, run long, {_HEAD}, counts array<binary>")


def _added_up(leaves: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of the documents of each run, all its radices together."""

    def add(leaf, got):
        known = dict(zip(got.column("radix").to_pylist(), got.column("counts").to_pylist()))
        rows, sums, bests = np.zeros(0, np.int64), None, None
        for radix, head, posts in sorted(zip(*(leaf.column(c).to_pylist() for c in ("radix", "head", "posts"))), key=lambda r: r[0]):
            if radix < 0:
                rows = np.cumsum(_unpack(head[0], np.int64)[0])
                sums, bests = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                continue
            totals, best = (np.concatenate(c) for c in zip(*(_unpack(c, np.int64, bool) for c in known[radix])))
            at = -1
            for frame in posts:
                begins, doc, n = _unpack(frame, bool, np.uint32, np.uint32)
                place = at + np.cumsum(begins)
                at = int(place[-1])
                np.add.at(sums, doc, n * totals[place])
                np.add.at(bests, doc, n * best[place].astype(np.int64))
        return pa.table({"row": rows, "n_best": bests if bests is not None else rows, "count_sum": sums if sums is not None else rows})

    return leaves.groupBy("run").cogroup(counts.groupBy("run")).applyInArrow(add, "row long, n_best long, count_sum long")


def _counted(docs: DataFrame, id_col: str, text_col: str, tokenizers: tuple[str, str], digest: bool) -> tuple[DataFrame, DataFrame, list[DataFrame], DataFrame]:
    """(encoded documents and runs, runs' rows, levels of heads from the runs' up, the last heads with counts)."""
    made = _encoded(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizers, digest)
    runs = made.filter("radix is not null").groupBy("part").agg((F.max("seq") + 1).alias("n"))
    before = runs.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    leaves = made.filter("radix is not null").join(before, "part").select("radix", (F.col("before") + F.col("seq")).alias("run"), "head", "posts")
    many = runs.agg(F.sum("n")).first()[0] or 0
    levels = [leaves.filter("radix >= 0").select("radix", "run", "head")]
    while len(levels) == 1 or many > 1:
        levels.append(cut(_merged(levels[-1])))
        many = -(-many // FAN)
    return made, leaves, levels, _topped(levels[-1], _layout(tokenizers))


def _layout(tokenizers: tuple[str, str]) -> Layout:
    return Layout(*(len(side(p, Path(p).read_bytes()).token) for p in tokenizers))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (TOKENIZER_A, TOKENIZER_B), digest: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A and B encode a space and the text. Where tokens of both end at one byte, a group ends, and its last two tokens are linked; a pair's
    count is the number of its links in all of docs, n_best are the links of which it is the highest of their B id (ties included), count_sum
    adds the counts up. groups is `a1,a2|b1;a3|b2,b3`, or with `digest` its SHA-256, which keeps what is written small.
    Null and empty texts, and those whose bytes a side doesn't give back, have zeros and an empty string. Rows that repeat an id
    each get a row, a null id too; other columns are ignored, whatever their names; an empty table gives an empty result."""
    made, leaves, levels, counts = _counted(docs, id_col, text_col, tokenizers, digest)
    for level in reversed(levels[:-1]):
        counts = _handed_down(level, counts)
    out = made.filter("radix is null").join(_added_up(leaves, counts), "row")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] = (TOKENIZER_A, TOKENIZER_B)) -> DataFrame:
    """(a, b, count, best) of each pair of ids that is linked in docs, as align() counts them; nothing for an empty table."""
    layout = _layout(tokenizers)

    def run(batches):
        for b in batches:
            for head, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for h, c in zip(head, counts):
                    n, best = _unpack(c, np.int64, bool)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*layout.ids(read_head(h)[0]), n, best)], names=["a", "b", "count", "best"])

    counts = _counted(docs, id_col, text_col, tokenizers, True)[-1]
    return counts.select("head", "counts").mapInArrow(run, "a long, b long, count long, best boolean")


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
