"""Secret scanning with a random forest that removes false positives.

Candidates are values assigned to names with a secret word, of any length and characters, the password of a URL's user, and runs of
twelve or more key-like characters with a digit. Their features are length, the transitions of their characters under the corpus's
letter pairs and between character classes, how much of them dictionary words cover, the path around them, and the neighbouring
words. The dictionary and the letter pairs are counted over all documents. The forest learns from labelled findings; where none are
given, from planted ones: keys, tokens and passwords, and hashes, numbers, placeholders and words that look like them, put into
sentences of the corpus's words. Their truth is known from how they were made, not from the features."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, least_hashed, table

_KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}(?:\.[A-Za-z0-9+/_-]{12,}){0,2}={0,2}(?![A-Za-z0-9+/_-])")
_NAME = re.compile(r"(?i)(?<![a-z])(?:[a-z0-9]{1,24}[_.-]){0,4}(?:password|passwd|pwd|pw|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)(?:[_.-][a-z0-9]{1,24}){0,4}[\"']?\s?$")
_ASSIGN, _VALUE = re.compile(r"[=:]"), re.compile(r">?\s?[\"']?([^\s\"',;]{4,})")
_USER = re.compile(r"(?<=://)[^\s/:@]{1,64}:([^\s/@]{4,})@")
_BEARER = re.compile(r"(?:[Bb]earer|BEARER)\s([A-Za-z0-9._~+/-]{8,}=*)")
WORD = re.compile(r"[^\W\d_]{3,30}")
#: Dictionary words broadcast, labelled findings that the forest learns from, planted ones, trees, depth, and the score that counts as a secret.
DICTIONARY, SAMPLE, PLANTED, TREES, DEPTH, THRESHOLD = 20_000, 20_000, 8000, 20, 9, 0.5
#: Words near a finding, by what they suggest (fixed values).
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "access", "auth", "bearer", "credential", "private")
OTHER_WORDS = ("commit", "sha", "md5", "hash", "uuid", "id", "order", "card", "phone", "tel", "iban", "isbn", "version", "example", "test", "placeholder", "checksum", "page", "line")
FEATURES = ("length", "digits", "upper", "lower", "other", "entropy", "switches", "pair_score", "coverage", "in_path", "path_depth", "test_path", "assigned", "quoted", "secret_words", "other_words", "hex", "digits_only", "repeats", "known_prefix")
_KNOWN = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{20,}")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates, in order and without overlaps; of those that overlap the first, and of these the longest."""
    spans = [m.span() for m in _KEYLIKE.finditer(text)] + [m.span(1) for p in (_USER, _BEARER) for m in p.finditer(text)]
    for m in _ASSIGN.finditer(text):
        if _NAME.search(text[max(0, m.start() - 64) : m.start()]) and (v := _VALUE.match(text, m.end())):
            spans.append(v.span(1))
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def features(text: str, start: int, end: int, path: str | None, words: set[str], pairs: np.ndarray) -> list[float]:
    """FEATURES of text[start:end]; words: the dictionary, pairs: log2 probabilities of letter pairs by code below 128."""
    c = text[start:end]
    n, counts = len(c), Counter(c)
    classes = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "o" for x in c]
    kinds = Counter(classes)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    switches = sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1)
    codes = np.frombuffer(c.lower().encode("ascii", "replace"), np.uint8) & 127
    pair = float(pairs[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0
    low, covered, k = c.lower(), 0, 0
    while k < n:  # longest dictionary word at each place
        m = next((m for m in range(min(20, n - k), 3, -1) if low[k : k + m] in words), 0)
        covered += m
        k += m or 1
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    near = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", before)[-3:] + re.findall(r"[A-Za-z_][A-Za-z0-9_]*", after)[:1]}
    place = (path or "").lower()
    return [
        float(n), kinds["d"] / n, kinds["u"] / n, kinds["l"] / n, kinds["o"] / n, entropy, switches, pair, covered / n,
        float("/" in c), float(c.count("/") + place.count("/")), float(any(w in place for w in ("test", "example", "sample", "doc"))), float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("'", '"')),
        float(sum(any(s in w for s in SECRET_WORDS) for w in near)), float(sum(w in OTHER_WORDS for w in near)), float(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c) is not None), float(c.isdigit()),
        max(counts.values()) / n, float(_KNOWN.fullmatch(c) is not None),
    ]


#: Where planted secrets, and what isn't one, stand (fixed values).
_SECRET_PLACES = ("password = {}", "password={}", "{w}_password: \"{}\"", "pwd: {}", "api_key = '{}'", "API_KEY={}", "secret: {}", "client_secret={}", "token: {}", "access_token=\"{}\"", "Authorization: Bearer {}", "postgres://{w}:{}@{w}.example.org/{w}", "{w} {} {w}", "key {}", "private_key={}")
_OTHER_PLACES = ("commit {}", "in commit {} of {w}", "sha {}", "md5 {}", "checksum: {}", "id {}", "uuid {}", "order {}", "card {} {w}", "page id={}", "phone {}", "version {}", "/usr/lib/{w}/{}", "{w}/{}", "iban {}", "isbn {}", "{w} {} {w}", "hash={}", "line {}")
_PLACEHOLDERS = ("changeme", "example", "<password>", "your_password_here", "xxxxxxxxxxxx", "${{PASSWORD}}", "placeholder", "none", "null", "********", "required", "optional", "12345678")


def planted(words: list[str], n: int, seed: int = 0) -> list[tuple[str, str, int]]:
    """n (text, finding, label): half of them secrets, half not, in sentences of the words."""
    rng = np.random.default_rng(seed)
    words = words or ["word"]
    word = lambda: words[int(rng.integers(len(words)))]
    letters = lambda chars, k: "".join(chars[int(i)] for i in rng.integers(len(chars), size=k))
    alnum, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"

    def secret() -> tuple[str, bool]:
        """A secret, and whether it shows itself without a name."""
        kind = int(rng.integers(9))
        if kind == 0:
            return "AKIA" + letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), True
        if kind == 1:
            return "ghp_" + letters(alnum, 36), True
        if kind == 2:
            return "sk_live_" + letters(alnum, 24), True
        if kind == 3:
            return ".".join(letters(alnum + "_-", int(k)) for k in rng.integers(16, 48, size=3)), False
        if kind == 4:
            return letters(hexes, int(rng.choice([32, 40, 64]))), False
        if kind == 5:
            return letters(alnum + "+/", int(rng.integers(20, 64))) + "=" * int(rng.integers(3)), False
        if kind == 6:
            return letters(alnum + "!#$%&*?", int(rng.integers(8, 20))), False
        if kind == 7:
            return word().capitalize() + letters("!#$_-", 1) + word() + letters("0123456789", int(rng.integers(1, 5))), False
        return "-".join(word() + letters("0123456789", int(rng.integers(0, 3))) for _ in range(3)), False

    def other() -> tuple[str, bool]:
        """What is no secret, and whether that holds behind a secret's name."""
        kind = int(rng.integers(9))
        if kind == 0:
            return letters(hexes, int(rng.choice([32, 40, 64]))), False
        if kind == 1:
            return "-".join(letters(hexes, k) for k in (8, 4, 4, 4, 12)), False
        if kind == 2:
            return letters("0123456789", int(rng.integers(12, 20))), False
        if kind == 3:
            return "-".join(letters("0123456789", 4) for _ in range(4)), False
        if kind == 4:
            return f"{word()}_{word()}-{letters('0123456789', 3)}.so", False
        if kind == 5:
            return _PLACEHOLDERS[int(rng.integers(len(_PLACEHOLDERS)))], True
        if kind == 6:
            return word() + "_" + word(), True
        if kind == 7:
            return letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + letters("0123456789", 18), False
        return f"{word()}{letters('0123456789', 1)}_{word()}_{word()}", False

    out = []
    for k in range(n):
        label = k % 2
        found, known = secret() if label else other()
        named = _SECRET_PLACES[:12] + _SECRET_PLACES[14:]
        places = (_SECRET_PLACES if known else named) if label else named if known else _OTHER_PLACES
        place = places[int(rng.integers(len(places)))]
        while "{w}" in place:
            place = place.replace("{w}", word(), 1)
        sentence = [word() for _ in range(int(rng.integers(3, 12)))]
        at = int(rng.integers(len(sentence)))
        out.append((" ".join([*sentence[:at], place.replace("{}", found, 1), *sentence[at:]]), found, label))
    return out


def planted_findings(spark, model, n: int = PLANTED) -> DataFrame:
    """(digest, start, features, label) of planted findings, in sentences of the dictionary's words; model: what findings() looks up."""
    texts = planted(sorted(model[0]), n)
    labels = {hashlib.sha256(f.encode()).hexdigest(): y for _, f, y in texts}
    docs = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(texts)], "doc_id long, text string").repartition(8)
    known = spark.createDataFrame(list(labels.items()), "digest string, label int")
    return findings(docs, model).join(F.broadcast(known), "digest").select("digest", "start", "features", "label")  # PLANTED rows


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased words of letters of all documents, and how often they occur."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counts.update(WORD.findall((t.as_py() or "").lower()))
                if len(counts) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The words of four letters and more that come as often as the most frequent class of words with at most `most` in it and above;
    classes of counts are a quarter of a doubling, so words of equal counts are in or out together."""
    long = words.filter(F.length("word") >= 4).withColumn("c", F.floor(F.log2("n") * 4).cast("int"))
    classes = sorted(((r["c"], r["many"]) for r in long.groupBy("c").agg(F.count("*").alias("many")).collect()), reverse=True)  # some hundred rows
    least, held = 10**6, 0
    for c, many in classes:
        if (held := held + many) > most:
            break
        least = c
    return long.filter(F.col("c") >= least).select("word").toArrow()["word"].to_pylist()  # `most` rows at most


def letter_pairs(words: DataFrame) -> np.ndarray:
    """log2 probabilities of a letter after another, by code below 128, over all words with their counts."""

    def run(batches):
        total = np.zeros(128 * 128)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(w.encode("ascii", "replace"), np.uint8).astype(np.int64) & 127
                total += 0 if len(c) < 2 else np.bincount(c[:-1] * 128 + c[1:], minlength=128 * 128) * float(n) if len(c) > 40 else 0
                for x, y in zip(c[:-1].tolist(), c[1:].tolist()) if len(c) <= 40 else ():
                    total[x * 128 + y] += n
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], names=["pair", "n"])

    out = np.full(128 * 128, 0.01)
    for r in words.mapInArrow(run, "pair int, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 16,384 rows
        out[r["pair"]] += r["n"]
    out = out.reshape(128, 128)
    return np.log2(out / out.sum(axis=1, keepdims=True))


def lookups(words: DataFrame) -> tuple[set, np.ndarray]:
    """The dictionary and the letter pairs."""
    return set(dictionary(words)), letter_pairs(words)


def findings(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """A row for each candidate of each text: id, start, length, digest (SHA-256 of the candidate), features; model: lookups()."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        known, pairs = shared.value
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                for s, e in candidates(text):
                    rows.append((k, s, e - s, hashlib.sha256(text[s:e].encode("utf-8", "surrogatepass")).hexdigest(), features(text, s, e, b.column(2)[k].as_py(), known, pairs)))
            if rows:
                cols = [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows])), *cols], names=["id", "start", "length", "digest", "features"])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path")).mapInArrow(run, f"id {kind}, start long, length long, digest string, features array<double>")


def forest(labelled: DataFrame, sample: int = SAMPLE):
    """A random forest on (features, label) of at most `sample` distinct findings; None without rows of both labels.

    Findings alike in digest, features and label are one, weighted by their number. Each label is sampled apart, by a hash, and
    gets half of the sample and what the other leaves; its weights then keep its share of all labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = cut(labelled.filter("label in (0, 1)").groupBy("digest", "features", "label").agg(F.count("*").cast("double").alias("n")))
    kinds = {r["label"]: r["many"] for r in rows.groupBy("label").agg(F.count("*").alias("many")).collect()}
    if len(kinds) < 2:
        return None
    parts = [least_hashed(rows.filter(F.col("label") == y), F.xxhash64("digest", "features"), max(sample // 2, sample - kinds[1 - y]), kinds[y], "digest") for y in (0, 1)]
    taken = cut(parts[0].unionByName(parts[1]))
    scale = rows.groupBy("label").agg(F.sum("n").alias("all")).join(taken.groupBy("label").agg(F.sum("n").alias("part")), "label")
    taken = cut(taken.join(F.broadcast(scale), "label").select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y"), (F.col("n") * F.col("all") / F.col("part")).alias("w")))
    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", predictionCol="_p", rawPredictionCol="_r", probabilityCol="_prob", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(taken)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """A row for each candidate: id, start and length in characters, digest, score (0 to 1), is_secret (score >= THRESHOLD).

    labelled: (digest, start, features, label) findings of both labels, else planted_findings(); with one label only, all findings have its
    score. Null and empty texts have no candidates; rows that repeat an id each have theirs; an empty table gives an empty result."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = lookups(cut(corpus_words(docs, text_col)))
    found = findings(docs, model, id_col, text_col, path_col)
    if labelled is None:
        labelled = planted_findings(docs.sparkSession, model)
    trained = forest(labelled)
    if trained is None:
        only = labelled.filter("label in (0, 1)").agg(F.max("label")).first()[0]
        scored = found.withColumn("score", F.lit(0.5 if only is None else float(only)))
    else:
        scored = trained.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("_prob")[1])
    return scored.select(F.col("id").alias(id_col), "start", "length", "digest", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), path_col="source")
