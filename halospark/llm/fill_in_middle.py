"""Fill-in-middle transformation, whose units are counted chunk by chunk of content.

A rolling hash over 32 characters cuts texts where its first bits are zero, so equal passages fall into equal chunks wherever they
stand. A task keeps what it has counted of a chunk under the chunk's whole content, not under its hash: its number of units, and
whether it begins and ends with a letter. A text's count is the sum over its chunks, less one wherever a run of letters goes on into
the next; running sums find the chunk of a cut, and only that chunk's unit ends are listed (and kept) to place the cut."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: A chunk has 2**BITS characters on average and at most LONGEST.
BITS, LONGEST = 10, 16_384
#: Characters of chunks that a task keeps; when they are more it begins anew, which costs time, not results.
KEPT = 16_000_000
#: Characters of texts put out together.
TOGETHER = 8_000_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
_MARKS = re.compile("<[PSM]>")
_MULT = np.uint32(0x9E3779B1)


def chunk_ends(text: str) -> np.ndarray:
    """Where the chunks of a text end, the last at its end."""
    if not text:
        return np.zeros(0, np.int64)
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * _MULT
    h = (h ^ h >> np.uint32(15)) * _MULT
    for s in (1, 2, 4, 8, 16):  # sum of the last 32 characters' hashes, each moved by its distance
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    ends = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    if not len(ends) or ends[-1] != len(text):
        ends = np.append(ends, len(text))
    long = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(long):
        begins = np.concatenate([[0], ends[:-1]])
        ends = np.unique(np.concatenate([ends, *(np.arange(begins[k] + LONGEST, ends[k], LONGEST) for k in long)]))
    return ends


class Chunk:
    """What is known of a chunk by itself: its units, and whether it begins and ends with a letter."""

    __slots__ = ("units", "opens", "closes", "ends")

    def __init__(self, content: str):
        self.units = sum(1 for _ in UNIT.finditer(content))
        self.opens, self.closes = (c.isascii() and c.isalpha() for c in (content[0], content[-1]))
        self.ends: np.ndarray | None = None


class Counted(NamedTuple):
    """A text's chunks and their running sums; upto: unit ends in the text up to each chunk's end."""

    chunks: list[Chunk]
    contents: list[str]
    begins: np.ndarray
    upto: np.ndarray

    @property
    def units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def place(self, k: int) -> int:
        """The number of characters of the first k units."""
        if k == 0:
            return 0
        at = int(np.searchsorted(self.upto, k))
        chunk = self.chunks[at]
        if chunk.ends is None:
            chunk.ends = np.fromiter((m.end() for m in UNIT.finditer(self.contents[at])), np.uint16, chunk.units)
        return int(self.begins[at]) + int(chunk.ends[k - (int(self.upto[at - 1]) if at else 0) - 1])


class ChunkCounts:
    """Counts texts' units, each chunk's once while it is kept."""

    def __init__(self, kept: int = KEPT):
        self.most, self.held, self.known = kept, 0, {}

    def count(self, text: str) -> Counted:
        ends = chunk_ends(text)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        if self.held > self.most:
            self.known, self.held = {}, 0
        chunks, contents = [], []
        for s, e in zip(begins.tolist(), ends.tolist()):
            content = text[s:e]
            chunk = self.known.get(content)
            if chunk is None:
                chunk = self.known[content] = Chunk(content)
                self.held += e - s
            chunks.append(chunk)
            contents.append(content)
        goes_on = [a.closes and b.opens for a, b in zip(chunks, chunks[1:])] + [False] * bool(chunks)
        return Counted(chunks, contents, begins, np.cumsum([c.units - g for c, g in zip(chunks, goes_on)], dtype=np.int64))


def transform(text: str, draws: tuple[int, int, int, int], counts: ChunkCounts, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text and its four draws."""
    counted = counts.count(text)
    n = counted.units
    if not text or draws[2] % 100 >= 100 - plain or _MARKS.search(text):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = counted.place(first), counted.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """A row for each row of docs: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    Units are runs of ASCII letters and single other characters. Draws are the first four 32-bit numbers of SHA-256 of "seed:id", so
    rows that repeat an id have equal draws, and a null id draws as an empty one. `plain` and `spm` are percentages, of all texts and of those
    that are not plain. Null texts count as empty; empty texts, and texts that hold a marker, are plain. Other columns are ignored,
    whatever their names. An empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]

    def run(batches):
        counts = ChunkCounts()
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

        def batch(ids, rows):
            return pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for b in batches:
            drawn = list(zip(*(b.column(k + 2).to_pylist() for k in range(4))))
            rows, since, held = [], 0, 0
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                rows.append(transform(text, drawn[k], counts, plain, spm))
                held += len(text)
                if held > TOGETHER:
                    yield batch(b.column(0).slice(since, len(rows)), rows)
                    rows, since, held = [], k + 1, 0
            yield batch(b.column(0).slice(since), rows)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *draws)
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form"):
    """Column: the text that an output was made from. Texts with markers of their own are plain, so three markers are the operator's."""
    parts = F.split(F.col(output), _MARKS.pattern, -1)
    text = F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(text)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
 CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
 CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
