"""Token alignment against the public libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from halospark.llm import token_alignment as TA

SCHEMA = "doc_id long, text string, lang string, row long, id string, radix int, run long, head string"
TEXTS = [
    None, "", "a", " ", "  two  spaces ", "Hello, world! It's 1234 o'clock.", "naïve café für Straße", "日本語のテキスト 😀😀", "<s>plain</s> <unk> <|endoftext|> <0x41>", "▁ a mark ▁of its▁ own",
    "tabs\tand\nlines\r\n\n\n", "x" * 3000, " " * 500, "a\u0000b", "the the the the", "ﬁ ligature ½ ①", " nbsp em", "é" * 200, "the. the, the; the: the!", "don't can't we'll they're",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "i", 2, 3, "h") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(TA.TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=TA.TOKENIZER_B)


def loops(libraries, rows):
    """Rows of align() by the rule, with the libraries' own ids and loops over tokens."""
    a_lib, b_lib = libraries
    char = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    char |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in char.values())}
    got = []
    for i, t in rows:
        want, a, b = b" " + (t or "").encode(), [], []
        if t:
            e = a_lib.encode(" " + t, add_special_tokens=False)
            a = list(zip(e.ids, (bytes(char[c] for c in x) for x in e.tokens)))
            b = [(k, bytes([int(p[3:5], 16)]) if b_lib.is_byte(k) else p.replace("▁", " ").encode()) for k in b_lib.encode(t) for p in [b_lib.id_to_piece(k)]]
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        groups, links, ia, ib = [], [], 0, 0
        while ia < len(a):
            ga, gb = [a[ia]], [b[ib]]
            ia, ib = ia + 1, ib + 1
            size = lambda g: sum(len(x) for _, x in g)
            while size(ga) != size(gb):
                if size(ga) < size(gb):
                    ga.append(a[ia])
                    ia += 1
                else:
                    gb.append(b[ib])
                    ib += 1
            groups.append((ga, gb))
            links.append((ga[-1][0], gb[-1][0]))
        got.append((i, len(a), len(b), ";".join("|".join(",".join(str(k) for k, _ in g) for g in x) for x in groups), links))
    count = Counter(x for g in got for x in g[4])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(i, na, nb, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), text) for i, na, nb, text, links in got], count, top


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def test_ids_are_the_libraries(libraries):
    from pathlib import Path

    sides = [TA.side(p, Path(p).read_bytes()) for p in (TA.TOKENIZER_A, TA.TOKENIZER_B)]
    texts = [t or "" for t in TEXTS]
    assert sides[0].encode(texts) == [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert sides[1].encode(texts) == libraries[1].encode(texts)
    layout = TA.Layout(50257, 32000)
    a, b = np.array([0, 50256, 17, 5]), np.array([0, 31999, 63, 64])
    assert [x.tolist() for x in layout.ids(layout.pair(a, b))] == [a.tolist(), b.tolist()] and (layout.radix(layout.pair(a, b)) == b % 64).all()


def test_heads_merge_as_counters(monkeypatch):
    monkeypatch.setattr(TA, "FRAME", 7)
    rng = random.Random(4)
    heads, want = [], Counter()
    for _ in range(9):
        c = {rng.randrange(300): rng.randrange(1, 2**40) for _ in range(rng.randrange(120))}
        want.update(c)
        heads.append(TA.head_frames(np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)], np.int64)))
    got = [(p, t) for pairs, totals in TA.merge_heads(heads) for p, t in zip(pairs.tolist(), totals.tolist())]
    assert got == sorted(want.items())
    assert list(TA.merge_heads([[], []])) == []
    assert TA.best_of(np.array([1, 1, 1, 4, 9, 9]), np.array([3, 5, 5, 1, 2, 1])).tolist() == [False, True, True, True, True, False]


def test_alignment_against_loops(spark, libraries):
    rng = random.Random(5)
    vocabulary = ["the", "tion", "ö", "über", "x1y", "1,234", "don't", "Zürich,", "\n", "▁"]
    rows = [*enumerate(TEXTS), (7, "twice"), (7, "twice"), (None, "no id"), (None, None)]
    rows += [(100 + k, " ".join(rng.choice(vocabulary[: 9 + k % 2]) for _ in range(rng.randrange(300)))) for k in range(80)]
    want, count, top = loops(libraries, rows)
    got = TA.align(frame(spark, rows)).collect()
    assert sorted_rows(got) == sorted_rows(want)
    assert any(w[5] < w[4] for w in want) and any(w[1] == 0 and r[1] for w, r in zip(want, rows))
    pairs = TA.pair_counts(frame(spark, rows)).collect()
    assert {(r["a"], r["b"]): (r["count"], r["best"]) for r in pairs} == {p: (n, n == top[p[1]]) for p, n in count.items()} and len(pairs) == len(count)
    digests = TA.align(frame(spark, rows), digest=True).select("doc_id", "groups").collect()
    assert sorted_rows(digests) == sorted_rows([(w[0], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want])
    assert TA.align(frame(spark, [])).count() == 0 and TA.pair_counts(frame(spark, [])).count() == 0


def test_many_small_runs_give_the_same(spark, monkeypatch, libraries):
    """Runs of a few links over three levels of merging."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gämma", "delta,", "it's"]) for _ in range(40))) for k in range(60)]
    for name, value in (("RUN_LINKS", 60), ("TOGETHER", 100), ("FAN", 3), ("FRAME", 5)):
        monkeypatch.setattr(TA, name, value)
    assert sorted_rows(TA.align(frame(spark, rows)).collect()) == sorted_rows(loops(libraries, rows)[0])
