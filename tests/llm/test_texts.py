"""Decontamination, mixing, WARC, token counts and language-model scores against brute force, and their edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from halospark.llm import context_mixing as CM
from halospark.llm import decontaminate as D
from halospark.llm import lm_score as LM
from halospark.llm import mixing, token_count, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, s string, rows long, mix_epoch int, held boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 5, "c", 6, 7, True) for i, t, s in rows], SCHEMA).repartition(3)


def words(n, seed=0):
    rng = random.Random(seed)
    return [f"w{rng.randrange(1000)}" for _ in range(n)]


def test_contained_items(spark):
    items = [(k, " ".join(words(n, k))) for k, n in enumerate((3, 5, 12, 30, 59, 200))] + [(90, None), (91, ""), (92, " ".join(words(12, 2)))]
    filler = words(4000, 77)
    docs = [
        (1, " ".join(filler[:2000] + words(30, 3) + filler[2000:]), "a"), (2, " ".join(filler[:10] + words(59, 4)[:50] + filler[10:]), "a"), (3, " ".join(words(12, 2)).upper().replace(" ", ", "), "a"),
        (4, " ".join(words(12, 2)[:6]), "a"), (5, None, "a"), (6, "", "a"), (7, " ".join(words(3, 0)), "a"), (8, " ".join(filler[:500] + words(200, 5)[:100] + filler[500:1500] + words(200, 5)[95:] + filler[1500:]), "a"),
        (3, " ".join(words(12, 2)), "a"), (None, " ".join(words(30, 3)), "a"), (9, " ".join(filler), "a"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t, _ in docs:
        own = set(D._shingles(D.words_of(t), 5))
        for j, x in items:
            q = set(D._shingles(D.words_of(x), 5))
            if q and len(q & own) >= 0.8 * len(q):
                want[i, j, len(q & own), len(q)] += 1
    got = D.contained_items(frame(spark, docs), table)
    assert Counter((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in got.collect()) == want
    assert {(1, 3), (2, 4), (3, 2), (3, 92), (8, 5), (None, 3), (7, 0)} == {(a, b) for a, b, *_ in want}
    clean = D.drop_contaminated(frame(spark, docs), table)
    assert sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 9] and clean.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").replace(" boolean", "").split(", ")
    assert D.contained_items(frame(spark, []), table).count() == 0 and D.contained_items(frame(spark, docs), table.limit(0)).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(words(20, k))) for k in range(9)]
    docs = frame(spark, [(k, " ".join(words(500, 50) + words(20, k)), "a") for k in range(9)])
    table = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.contained_items(docs, table).collect()))
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    assert sorted(map(tuple, D.contained_items(docs, table).collect())) == one and len(one) == 9


def mixed(rows, entropy, repeats, budget):
    """The mix by plain loops: (id, source, epoch) counts."""
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len((t or "").encode().split())
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}

    def bisect(ok):
        lo, hi = 0.0, 1.0
        if ok(lo):
            return lo
        if not ok(hi):
            return hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        return hi

    w = lambda a: {s: x**a / sum(y**a for y in p.values()) for s, x in p.items()}
    a = round(max(bisect(lambda a: -sum(x * math.log(x) for x in w(a).values()) <= entropy * math.log(len(p))), bisect(lambda a: max(w(a)[s] * budget / p[s] for s in p) <= repeats)), 9) if len(p) > 1 else 1.0
    out = Counter()
    for s in tokens:
        own = [(i, len((t or "").encode().split())) for i, t, x in rows if x == s]
        quota = math.floor(w(a)[s] * budget * total) if tokens[s] else 0
        epochs = quota // tokens[s] if tokens[s] else 1
        rest = quota - epochs * tokens[s] if tokens[s] else 0
        import hashlib

        key = lambda i: hashlib.md5(f"{mixing.SEED}:{epochs}:{'null' if i is None else i}".encode()).hexdigest()
        for i, _ in own:
            more = rest > 0 and sum(n for j, n in own if key(j) <= key(i)) <= rest
            for e in range(epochs + more):
                out[i, s, e] += 1
    return out


@pytest.mark.parametrize("entropy,repeats,budget", [(0.97, 4.0, 1.0), (0.9, 1.5, 2.0), (1.0, 50.0, 1.0), (0.5, 3.0, 0.4)])
def test_mix_against_loops(spark, entropy, repeats, budget):
    rows = [(k, " ".join(words(5 + k % 11)), "big") for k in range(60)] + [(100 + k, " ".join(words(8 + k)), "mid") for k in range(9)] + [(200, "x y z", None), (None, "p q", "mid"), (201, None, "big"), (202, None, "none"), (203, "a b", "one"), (203, "a b", "one")]
    got = mixing.mix(frame(spark, rows), entropy=entropy, repeats=repeats, budget=budget)
    assert Counter((r["doc_id"], r["source"], r["mix_epoch"]) for r in got.collect()) == mixed(rows, entropy, repeats, budget)
    assert [c for c in got.columns if c not in ("mix_epoch", "mix_key")] == [c for c in frame(spark, []).columns if c != "mix_epoch"]


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\n</p>" * 9000
    pages = [(5, "http://a/", "<html>x</html>"), (3, None, "<html>x</html>"), (9, "http://b/\r\nX: y", long), (1, "u", None), (2, "u", ""), (None, "n", "<html>x</html>"), (None, "n", "only here"), (3, "again", "<html>x</html>"), (7, "l", long)]
    df = spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id long, url string, html string, id long, record string").repartition(2)
    path = f"file://{tmp_path}/arc"
    warc.write_warc(df, path, segment=1000)
    got = warc.read_warc(spark, path).collect()
    first: dict = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in pages:
        h, one = h or "", first.get(h or "")
        again = one is not None and i != one
        want[i, len(h.encode()), warc.sha1_base32(h.encode()), "revisit" if again else "response", one if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["problem"] is None for r in got) and {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {h or "" for _, _, h in pages}
    small = f"file://{tmp_path}/small"
    warc.write_warc(df, small, least=100)
    assert Counter(r["record_type"] for r in warc.read_warc(spark, small).collect()) == {"response": 8, "revisit": 1}
    empty = f"file://{tmp_path}/empty"
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_finds_broken_records(spark, tmp_path):
    parts = warc.page_records(4, 0, "u", "x" * 5000, None, segment=1000)
    chunks = warc.chunked(b"abc" * 1000, 100)
    assert warc.dechunk(chunks) == b"abc" * 1000
    with pytest.raises(ValueError):
        warc.dechunk(chunks.replace(b"\r\n", b"\n\n", 3))
    whole = b"".join(p + b"\r\n\r\n" for p in parts)
    lost = b"".join(p + b"\r\n\r\n" for k, p in enumerate(parts) if k != 2)
    for name, data, problem in (("whole", whole, None), ("lost", lost, "segments are missing"), ("short", whole.replace(b"WARC-Segment-Total-Length: 5", b"WARC-Segment-Total-Length: 6"), "total length differs")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        assert [r["problem"] for r in warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()] == [problem]


def test_warc_ids_of_any_text(spark, tmp_path):
    ids = ["a:b", "", None, "%41", "é\r\n>", "%", "<urn:x-page:1>", "a:c"]
    pages = [(i, "u", f"<p>{k // 2}</p>") for k, i in enumerate(ids)]
    path = f"file://{tmp_path}/arc"
    warc.write_warc(spark.createDataFrame(pages, "page_id string, url string, html string"), path)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path, "string").collect()}
    want = set()
    for k, i in enumerate(ids):
        one = min((x for x in ids[k // 2 * 2 : k // 2 * 2 + 2] if x is not None), default=None)
        want.add((i, "response" if i == one else "revisit", None if i == one else one))
    assert got == want


def test_warc_reads_other_records_and_goes_on_after_broken_ones(spark, tmp_path):
    import gzip

    end = b"\r\n\r\n"
    whole = [p for k in range(3) for p in warc.page_records(k, k, "u", f"<p>{k}</p>", None)]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nx: y"
    bad = [b"nonsense", b"WARC/1.1\r\nWARC-Type: request\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nshort"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"".join(p + end for p in [info, whole[0], bad[0], whole[1], bad[1], bad[2], whole[2]]))
    (tmp_path / "a" / "y.warc.gz").write_bytes(b"".join(gzip.compress(p + end) for p in whole) + gzip.compress(whole[0])[:-60])
    rows = warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    sound = Counter((r["page_id"], r["record_type"], bytes(r["payload"])) for r in rows if r["problem"] is None)
    assert sound == {(None, "warcinfo", b"x: y"): 1, **{(k, "response", f"<p>{k}</p>".encode()): 2 for k in range(3)}}
    assert {r["problem"].split(" at ")[0].split(":")[0] for r in rows if r["problem"]} == {"no record", "the record", "compression"}


def brute_tokens(text, pieces):
    """Tokens of the best segmentation by a plain forward pass over each pre-token."""
    total = 0
    for word in text.split():
        s, best = "▁" + word, [(0.0, 0)]
        for end in range(1, len(s) + 1):
            n = len(s[end - 1].encode())
            options = [(best[end - 1][0] + n * token_count.BYTE, 0, best[end - 1][1] + n)]
            options += [(best[k][0] + pieces[s[k:end]], end - k, best[k][1] + 1) for k in range(end) if s[k:end] in pieces]
            top = max(options)
            best.append((top[0], top[2]))
        total += best[-1][1]
    return total


def test_token_counts(spark):
    pieces = token_count.pieces_of()
    texts = [(1, "The quick brown fox, unbelievable tokenisation tokens tokenised"), (2, None), (3, ""), (4, " \n\t"), (1, "The quick"), (None, "naïve 日本 \U0001f600"), (5, "antidisestablishmentarianism " * 3000), (6, "x" * 3000)]
    got = Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"], r["n_bytes"]) for r in token_count.count_tokens(frame(spark, [(i, t, "a") for i, t in texts])).collect())
    assert got == Counter((i, len((t or "").split()), brute_tokens(t or "", pieces), len((t or "").encode())) for i, t in texts)
    assert token_count.count_tokens(frame(spark, [])).count() == 0
    small = token_count.UnigramTrie(pieces, nodes=40)  # begun anew again and again
    for w in texts[0][1].split() * 2:
        assert small.count("▁" + w) == brute_tokens(w, pieces)


def test_lm_base_score_and_normalisation(spark):
    rows = [(k, " ".join(words(40 + k % 50, k % 9)) + " Common THE the", "a") for k in range(120)] + [(500, None, "a"), (None, "the the", "a"), (3, "the odd", "a"), (501, "y" * 4000 + " " + "z" * 400, "a")]
    got = LM.score_texts(frame(spark, rows)).collect()
    counts, ends = Counter(), 0
    for i, t, _ in rows:
        if zlib.crc32(str('' if i is None else i).encode()) % LM.FOLDS:
            counts.update(LM.tokens_of(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = Counter()
    for i, t, _ in rows:
        toks = LM.tokens_of(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        want[i, zlib.crc32(str('' if i is None else i).encode()) % LM.FOLDS == 0, len(toks) + 1, sum(counts[w] > 0 for w in toks) + 1, n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert LM.score_texts(frame(spark, [])).count() == 0


def trained_on(texts, seed=1):
    """A model of words, its tables counted in plain loops and its mixer taught on every other text."""
    counts = Counter(w for t in texts for w in LM.tokens_of(t))
    head = sorted(w for w, n in counts.items() if n > 1)
    contexts = CM.WordContexts(head, np.array([counts[w] for w in head], float), sum(n for n in counts.values() if n == 1), len(texts), 14)
    zeros, ones = np.zeros((2, contexts.offsets[-1]))
    mixer = CM.Mixer(contexts.predictors)
    for part in (texts[::2], texts[1::2]):
        for e in contexts.stream(part):
            if part is texts[1::2]:
                mixer.learn(*(lambda x: (x[0], e, x[1]))(mixer.look(CM.inputs(zeros, ones), e)))
            for slots in e.slots.tolist():
                for s, bit in zip(slots, e.bits.tolist()):
                    (ones if bit else zeros)[s] += 1
    for e in contexts.stream(texts[1::2]):
        mixer.learn(*(lambda x: (x[0], e, x[1]))(mixer.look(CM.inputs(zeros, ones), e)))
    return LM.Model(contexts, CM.inputs(zeros, ones), mixer)


def test_lm_codes_and_spellings_are_probabilities():
    model = trained_on([" ".join(words(60, k % 7)) for k in range(40)])
    contexts, code = model.contexts, model.contexts.code
    assert len(code.size) == contexts.end + 1 and sum(2.0 ** -int(n) for n in code.size) == 1.0  # a full prefix code
    after = contexts.gather([(0, b"w1 w2", [], True)])[1][:, -1:]
    total = sum(10.0 ** model.follow(np.array([k]), after, np.array([1]))[0] for k in range(len(code.size)))
    assert abs(total - 1) < 1e-3
    speller = LM.Model(CM.SpellingContexts(12), np.zeros(int(CM.SpellingContexts(12).offsets[-1]), np.int8), CM.Mixer(4))
    one = sum(10.0**x for x in speller.spell([bytes([c]) for c in range(256) if c != 0x20]))
    assert 0 < one < 1


def test_lm_score_against_bits_one_by_one():
    """The same model in plain Python: weights stand still in a turn of the text and learn after it."""
    model = trained_on([" ".join(words(50 + k, k % 5)) for k in range(30)])
    text = " ".join(words(150, 3) + ["w1", "w2", "unseen"] * 5)
    contexts, mixer = model.contexts, model.mixer
    codes, hashes, *_ = contexts.gather([(0, *p) for p in CM.pieces(text)])
    w, sums, many, total = mixer.w.astype(float).copy(), np.zeros(mixer.w.shape), np.zeros(mixer.gates), 0.0
    for at, code in enumerate(codes):
        if at in LM.TURNS.tolist():
            w += LM.OWN_RATE * sums / (many + LM.OWN_CALM)
            sums, many = np.zeros(mixer.w.shape), np.zeros(mixer.gates)
        e = contexts.events(np.array([code]), hashes[:, at : at + 1])
        for k, bit in enumerate(e.bits.tolist()):
            x = [model.inputs[e.slots[j, k]] / CM.SCALE for j in range(mixer.k)]
            gate = int(e.place[k]) + CM.PLACES * sum((x[j] != 0) << j - 1 for j in range(1, mixer.k))
            z = max(-CM.LIMIT, min(CM.LIMIT, w[-1, gate] + sum(w[j, gate] * x[j] for j in range(mixer.k))))
            p, place = 1 / (1 + math.exp(-z)), int(e.place[k]) * CM.BINS + int(min((z + CM.LIMIT) * CM.BINS / (2 * CM.LIMIT), CM.BINS - 1))
            fine = (p + (mixer.ones[place] + 8 * p) / (mixer.all[place] + 8)) / 2
            total += math.log10(min(max(fine if bit else 1 - fine, 1e-6), 1 - 1e-6))
            sums[:, gate] += (bit - p) * np.array([*x, 1.0])
            many[gate] += 1
    assert abs(model.follow(codes, hashes, np.array([len(codes)]))[0] - total) < 1e-3 * abs(total)
    two = model.follow(np.append(codes, codes[:7]), np.concatenate([hashes, hashes[:, :7]], axis=1), np.array([len(codes), 7]))
    assert abs(two[0] - total) < 1e-3 * abs(total)  # no text moves another's weights


def test_lm_pieces_are_the_text(monkeypatch):
    monkeypatch.setattr(CM, "WINDOW", 64)
    contexts = CM.WordContexts([b"a", b"b"], np.array([3.0, 2.0]), 1, 1, 12)
    for text in (None, "", " ", "a" * 500, "a b " * 100, " ".join(words(300)) + "\n", "A\x0bB\x1cb é"):
        parts = list(CM.pieces(text))
        assert sum((p[0].split() for p in parts), []) == LM.tokens_of(text) and (len(parts) > 3 or len(text or "") < 600)
        words_of = CM.Words((text or "").encode().lower())
        assert words_of.take(np.arange(len(words_of.starts))) == LM.tokens_of(text) and len(set(words_of.hashes.tolist())) == len(set(LM.tokens_of(text)))
        whole, cut = contexts.gather([(0, (text or "").encode().lower(), [], True)]), contexts.gather([(0, *p) for p in parts])
        assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
        assert [w for w in LM.tokens_of(text) if w not in (b"a", b"b")] == cut[3]


def test_lm_beats_its_base_on_held_out_texts(spark):
    rows = LM.op4_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    better = sum(r["score"] > r["base_score"] for r in rows)
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows) and better > len(rows) / 2


def test_lm_hears_the_order_of_words(spark):
    rng = random.Random(4)
    turns = [[f"p{k}", f"q{k}", f"r{k}"] for k in range(40)]
    made = [" ".join(w for k in rng.choices(range(40), k=40) for w in turns[k]) for _ in range(300)]
    mixed_up = [" ".join(rng.sample(t.split(), 120)) for t in made]
    rows = [(k, t, "a") for k, t in enumerate(made)] + [(1000 + k, t, "a") for k, t in enumerate(mixed_up) if LM_held(1000 + k)]
    score = {r["doc_id"]: r["score"] for r in LM.score_texts(frame(spark, rows)).filter("held_out").collect()}
    right, wrong = ([v for i, v in score.items() if (i >= 1000) == late] for late in (False, True))
    assert len(wrong) > 5 and sum(right) / len(right) > 0.7 * sum(wrong) / len(wrong)


def LM_held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % LM.FOLDS == 0


def test_drop_contaminated_decides_by_row(spark):
    dirty = " ".join(words(30, 3))
    rows = [(None, dirty, "a"), (None, "clean row without an id", "a"), (7, dirty, "a"), (7, "clean row of a repeated id", "a"), (8, None, "a")]
    kept = D.drop_contaminated(frame(spark, rows), spark.createDataFrame([(1, dirty)], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.filter("text is not null").collect()) == [(0, "clean row without an id"), (7, "clean row of a repeated id")]
    assert kept.filter("text is null").count() == 1


def test_scores_are_made_of_many_texts_together(monkeypatch):
    """op4: a call for every 64 KB of texts at most, with the scores that each text has by itself."""
    texts = [" ".join(f"w{(k * 7919 + j * j) % 97}" for j in range(k % 400)) for k in range(300)]
    tokens = [w for t in texts for w in LM.tokens_of(t)]
    head = sorted(set(tokens))[10:]
    contexts = LM.WordContexts(head, np.array([float(tokens.count(w)) for w in head]), 50, len(texts), 16)
    table = np.random.default_rng(4).integers(-40, 40, int(contexts.offsets[-1])).astype(np.int8)
    scorer = LM.Texts(LM.Model(contexts, table, LM.Mixer(3)), np.zeros(len(head)), 0.0)
    calls, events = [], LM.WordContexts.events
    monkeypatch.setattr(LM.WordContexts, "events", lambda self, *a: calls.append(1) or events(self, *a))
    got, many, size = scorer.score(texts), len(calls), sum(map(len, texts))
    alone = [scorer.score([t])[0] for t in texts]
    assert size > 150_000 and many <= size // 65_536 + 1 and [g[:3] for g in got] == [a[:3] for a in alone] and np.allclose([g[3] for g in got], [a[3] for a in alone], rtol=1e-12)
