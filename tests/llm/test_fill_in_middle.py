"""Fill-in-middle against a plain regular expression, and its edge cases."""

import hashlib
import random
import re

from halospark.llm import fill_in_middle as FM

SCHEMA = "doc_id long, text string, lang string, n long, form string, output string, id long, h0 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 5, "f", "o", 6, "h") for i, t in rows], SCHEMA).repartition(3)


def loops(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) straight from the rule."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def text_of(rng, n):
    return "".join(rng.choice(["word", "Ab", " ", ", ", "\n", "é", "ß", "日本", "😀", "x1", "<", ">", "\t", "ſ", "K"]) for _ in range(n))


def test_chunks_cover_texts_and_equal_passages_share_them():
    rng = random.Random(1)
    for n in (0, 1, 2, 31, 32, 33, 5000):
        text = text_of(rng, n)
        ends = FM.chunk_ends(text)
        assert (len(ends) == 0 and not text) or (ends[-1] == len(text) and (ends[1:] > ends[:-1]).all() and ends[0] > 0)
    shared = text_of(rng, 20_000)
    chunks = lambda t: {t[a:b] for a, b in zip([0, *FM.chunk_ends(t)], FM.chunk_ends(t))}
    one, two = chunks("some head " + shared), chunks("another, much longer head " * 7 + shared + " and tail")
    assert len(one & two) >= len(one) - 2 > 10
    assert max(map(len, chunks("a" * 100_000))) <= FM.LONGEST


def test_places_of_all_units():
    counts = FM.ChunkCounts()
    rng = random.Random(2)
    for text in (text_of(rng, 3000), "a" * 70_000, "ab " * 9000, " " * 20_000 + "é", "A", "-", ("x" * 16_384) * 2 + "." + "y" * 40_000):
        ends = [m.end() for m in FM.UNIT.finditer(text)]
        for _ in range(2):  # counted anew and remembered
            counted = counts.count(text)
            assert counted.units == len(ends) and counted.place(0) == 0
            assert [counted.place(k + 1) for k in range(len(ends))] == ends
    small = FM.ChunkCounts(kept=100)
    assert [small.count(t).units for t in ("ab, " * 2000, "ab, " * 2000)] == [6000, 6000] and small.held <= 8000 + FM.LONGEST


def test_outputs_are_the_rule_and_texts_come_back(spark):
    rng = random.Random(3)
    rows = [(k, text_of(rng, rng.randrange(400))) for k in range(300)]
    rows += [(1000 + k, t) for k, t in enumerate([None, "", "a", "<P> in it", "x<S>", "<M>", "<", "<P", "ab<<S" * 40, "a" * 300_000, text_of(rng, 60_000), "é" * 3000])]
    rows += [(7, rows[7][1]), (7, "another text"), (None, "no id, " * 30), (None, None), (-5, "negative id " * 9)]
    got = FM.fill_in_middle(frame(spark, rows)).withColumn("back", FM.restored()).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    want = sorted(((i, *loops(i, t), t or "") for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert FM.fill_in_middle(frame(spark, [])).count() == 0


def test_shares_and_seed(spark):
    docs = frame(spark, [(k, "some words in a text") for k in range(4000)])
    forms = {r["form"]: r["count"] for r in FM.fill_in_middle(docs).groupBy("form").count().collect()}
    assert 320 < forms["plain"] < 480 and 620 < forms["spm"] < 820
    assert {r["form"] for r in FM.fill_in_middle(docs, seed=9, plain=0, spm=100).collect()} == {"spm"}
    both = [sorted(map(tuple, FM.fill_in_middle(docs, seed=s).collect())) for s in (1, 2)]
    assert both[0] != both[1]
