"""Personal data: the rules against their plain patterns, the trees on forms they were not shown, and edge cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from halospark.llm import personal_data as P

SCHEMA = "doc_id long, text string, lang string, id string, base string, spans string, kind string, redacted string"
PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "i", "b", "s", "k", "r") for i, t in rows], SCHEMA).repartition(3)


def check(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def loops(text):
    """The rules by the patterns as they are stated."""
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 14 <= len(digits) <= 19 and check(digits)) or (k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def selector():
    return P.Selector(*P.labelled_candidates(P.planted(["the words of a passage go on and on", "ein Text mit 12 Worten, der 1999 endet."], 9000)))


def test_rules_are_their_patterns():
    rng = random.Random(1)
    for alphabet in ("a1@.", "0123456789.", "4 -0123456789", "+1 (23).-5", "a@.-1+ %é", "ab@c.d9 +(1)-٣２é\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert P.base_spans(text) == loops(text), text
    cards = "4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 4111111111111111 4111111111111111 x4111111111111111x"
    assert P.base_spans(cards) == loops(cards) and len(loops(cards)) >= 2
    assert P.base_spans("١٢٣.١.١.١ １.２.３.４") == []


def test_rules_and_candidates_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 150_000, "+1(" * 100_000, "1-" * 150_000, "a.a at " * 30_000, "at dot " * 40_000, "f:" * 100_000, "a@b." * 50_000, "x at y dot " * 20_000):
        began = time.time()
        P.base_spans(text)
        P.candidates(text)
        assert time.time() - began < 15, text[:12]


def test_forms_that_were_not_planted(selector):
    """Names, hosts, separators and sentences of their own, none of them in planted()."""
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    names, hosts = ("karl.ohm", "zoe_v", "r2d2", "help-desk", "Q.Tran"), ("orchard", "blue-lake", "northwind9", "fundus")

    def card():
        d = "5" + digits(14)
        return d + next(c for c in "0123456789" if check(d + c))

    real = {
        "email": lambda: f"please reach {rng.choice(names)}{rng.choice([' <at> ', '<at>', ' [AT] '])}{rng.choice(hosts)}{rng.choice([' <dot> ', '[.]', ' (dot) '])}{rng.choice(['org', 'net', 'de'])} soon",
        "ip": lambda: f"blocked {'{.}'.join(str(rng.randrange(256)) for _ in range(4))} twice" if rng.random() < 0.5 else f"route 2a00:1450:{rng.randrange(4096):x}::{rng.randrange(4096):x} is up",
        "card": lambda: (lambda c: f"charged on {c[:4]}{s}{c[4:8]}{s}{c[8:12]}{s}{c[12:]} again")(card()) if (s := rng.choice(["  ", ".", " / "])) else "",
        "phone": lambda: f"my {rng.choice(['mobile', 'fax', 'telephone'])} is {rng.choice([f'({digits(3)}) {digits(3)} - {digits(4)}', f'{rng.randrange(200, 990)}-{digits(3)}-{digits(4)}', f'0{digits(3)} {digits(7)}'])} these days",
    }
    unreal = (
        lambda: f"published {rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} by", lambda: f"a sum of {digits(2)},{digits(3)},{digits(3)} was", lambda: f"they met at noon. Then he left. At {digits(1)}.30 it", lambda: f"stood at gate. Nobody saw",
        lambda: f"sizes {digits(2)} {digits(2)} {digits(2)} {digits(2)} of", lambda: f"from {digits(2)}:{digits(2)}:{digits(2)} until", lambda: f"page {digits(3)}-{digits(3)} and", lambda: f"build v{digits(1)}.{digits(2)}.{digits(1)} runs", lambda: f"order {digits(12)} shipped", lambda: "call std::move at once",
    )
    for kind, make in real.items():
        hit = 0
        for _ in range(200):
            text = f"some words before {make()} and some after"
            _, spans = selector.select(text)
            hit += any(P.KINDS[s[1]] == kind and s[2] - s[0] > 6 for s in spans)
        assert hit >= 170, (kind, hit)
    wrong = sum(bool(selector.select(f"some words before {rng.choice(unreal)()} and some after")[1]) for _ in range(600))
    assert wrong <= 18, wrong


def test_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    chance = 1 / (1 + np.exp(-3 * (x[:, 0] * (x[:, 1] > 0) + 0.3 * x[:, 2])))
    y = (rng.random(3000) < chance).astype(float)
    trees = P.Boosted(x[:2000], y[:2000])
    p = 1 / (1 + np.exp(-trees.score(x[2000:])))
    loss = lambda q: -np.mean(np.log(np.where(y[2000:] == 1, q, 1 - q)))
    assert loss(p) < 0.85 * loss(np.full(1000, y.mean())) and len(trees.score(x[:0])) == 0
    one = [float(sum(t[tuple_leaf(trees, k, r)] for k, t in enumerate(trees.leaf)) + trees.start) for r in x[:20]]
    assert np.allclose(one, trees.score(x[:20]))


def tuple_leaf(trees, k, row):
    """The leaf of a row in tree k by plain steps."""
    node = 0
    for _ in range(trees.depth):
        node = 2 * node + (2 if row[trees.feature[k, node]] > trees.cut[k, node] else 1)
    return node - trees.feature.shape[1]


def test_find_keeps_the_rules_and_redacts(spark):
    texts = [
        None, "", "nothing here", "write a.b@c.de or +1 (310) 555-4510 or 10.0.0.255 or 4111 1111 1111 1111.", "4111111111111111 4111111111111111", "é😀 x@y.zz, 300.1.1.1 +12 34", "reach anna [at] example [dot] org or call (310) 555-4511", "a@b.c@d.e",
        "words " * 20_000 + "tel. (212) 555-0199", "1.2.3.4.5.6.7.8",
    ]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[3])]
    got = P.find(frame(spark, rows), redact=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i, _ in rows)
    for r in got:
        text = (texts[3] if r["doc_id"] is None else texts[r["doc_id"]]) or ""
        tuples = lambda c, r=r: [(s["start"], P.KINDS.index(s["kind"]), s["end"]) for s in r[c]]
        base, spans = tuples("base"), tuples("spans")
        assert base == loops(text) and set(base) <= set(spans) and spans == sorted(spans)
        added = [s for s in spans if s not in base]
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in added for b in spans if a != b)
        assert all(text[a:b] not in r["redacted"] for a, _, b in spans) and (r["redacted"] == text) == (not spans)
        if r["doc_id"] == 4:
            assert [text[a:b] for a, _, b in added] == ["4111111111111111"] * 2
        if r["doc_id"] == 6:
            assert r["redacted"] == "reach [EMAIL] or call [PHONE]"
    assert P.find(frame(spark, [])).count() == 0


def test_labelled_findings_are_learnt(spark):
    """Labels that turn the usual ones round: order numbers are phones, numbers after "call" are nothing."""
    rng = random.Random(4)
    made = []
    for k in range(1200):
        n = f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        lead = f"w{k} of the {'order' if k % 2 else 'call'} "
        made.append((lead + n + " and on", len(lead), len(lead) + len(n), "phone" if k % 2 else "none"))
    labelled = spark.createDataFrame(made, "text string, start int, end int, kind string")
    got = {r["doc_id"]: len(r["spans"]) for r in P.find(frame(spark, [(1, "an order 321-654-9870 came"), (2, "a call 321-654-9870 came")]), labelled=labelled).collect()}
    assert got == {1: 1, 2: 0}


def test_query_columns(spark):
    from halospark.llm.registry import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op11_personal_data"](spark, "/root/testdata/sf0.001").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base = loops(text)
        line = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(b[1] == n for b in base) for n in range(4)]
        assert set(line.split(",")) <= set(got[i]["spans"].split(",")) or not line
