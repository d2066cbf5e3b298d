"""Exact and near deduplication against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from halospark.llm import exact_dedup, near_copies, simhash
from halospark.llm.common import attach, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _sha string, row long, fp long, n long, digest string, keep string"


def edge_rows():
    long = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
    texts = [
        (1, "Hello World foo bar baz qux"), (2, "HELLO world foo bar baz qux"), (3, None), (4, ""), (5, "  \t\n"), (None, "hello world foo bar baz qux"), (1, "Hello World foo bar baz qux"),
        (6, "É ünï \U0001f600 ß"), (7, long), (8, long + " tail"), (9, "one"), (10, "two words"), (None, None), (11, "é ünï \U0001f600 ß"),
    ]
    return [(i, t, None, "s", 0, "clash", "clash", 1, 2, 3, "d", "k") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, docs, keep):
    groups: dict = {}
    for i, t, *_ in edge_rows():
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
    got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
    assert len(got) == len(edge_rows())
    by: dict = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert by.keys() == groups.keys()
    pick = max if keep == "largest" else min
    for h, rows in by.items():
        ids = [i for i in groups[h] if i is not None]
        assert all(r["keep_id"] == (pick(ids) if ids else None) and r["group_size"] == len(groups[h]) for r in rows)
        assert [r["doc_id"] for r in rows if r["kept"]] == [pick(ids) if ids else None]


def test_exact_tree_over_many_runs(spark):
    rows = spark.range(0, 4000, 1, 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), (F.col("id") % 7).cast("string")).alias("text"))
    got = exact_dedup.exact_duplicates(rows).filter("kept").select("doc_id", "group_size").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(7)) and sum(r["group_size"] for r in got) == 4000


def test_drop_exact_copies_keeps_one_of_each_and_all_columns(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(t) for _, t, *_ in edge_rows()})


def test_fingerprint_by_hand():
    for text in [t for _, t, *_ in edge_rows()] + ["a b c d", "x " * 5000]:
        words = norm(text).encode().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text) == want


def test_fingerprint_hash_is_sparks(spark):
    r = spark.sql("SELECT xxhash64('ab cd é') AS h").first()["h"]
    assert r % 2**64 == xxhash.xxh64_intdigest("ab cd é".encode(), 42)


@pytest.mark.parametrize("tree", [20_000, 3])
def test_links_against_brute_force(spark, tree):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(rng.choice([0, 1, 6])):
            w = v
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                w ^= 1 << b
            values.add(w)
    base = rng.getrandbits(64)
    values |= {base ^ 1 << b for b in range(40)} | {base}  # one shard with many
    values = sorted(values)
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.link(prints, 3, tree).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64) for r in links)
    back = {signed(v): v for v in values}
    down = {v: v for v in values}

    def low(v):
        while down[v] != v:
            v = down[v]
        return v

    for r in links:
        down[low(back[r["a"]])] = low(back[r["b"]])
    same = lambda f: {frozenset(v for v in values if f(v) == x) for x in {f(v) for v in values}}
    assert same(root) == same(low)


def test_links_of_a_common_block_value(spark):
    """Fingerprints that share 16 bits, many more than a tree holds: planted pairs are linked, and only what is near."""
    rng = np.random.default_rng(5)
    low = np.unique(rng.integers(0, 2**48, 40_000, np.uint64))
    planted = [(int(v), int(v) ^ sum(1 << int(b) for b in rng.choice(48, k, False))) for k, v in zip([1, 2, 3] * 100, low[::130])]
    values = sorted({*low.tolist(), *(b for _, b in planted)})
    values = [v | 0x1234 << 48 for v in values]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.link(prints, 3, 1500).collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in links)
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        up[root(a)] = root(b)
    assert all(root(a | 0x1234 << 48) == root(b | 0x1234 << 48) for a, b in planted)


def test_bk_tree_finds_all_within():
    rng = random.Random(1)
    tree, values = simhash.BKTree(), list({rng.getrandbits(64) & 0xFFFF for _ in range(500)})
    for v in values:
        tree.add(v)
    for q in values[:50]:
        for radius in (0, 3, 5):
            assert {tree.values[k] for k in tree.within(q, radius)} == {v for v in values if (v ^ q).bit_count() <= radius}


def test_near_duplicates_edges(docs):
    rows = edge_rows()
    prints = [simhash.fingerprint(t) for _, t, *_ in rows]
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r["fingerprint"] for r in got} == {f"{p:016x}" for p in prints}
    for r in got:
        group = [i for (i, *_), p in zip(rows, prints) if (p ^ int(r["fingerprint"], 16)).bit_count() <= 3 and i is not None]
        assert r["component_id"] == min(group)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in got}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(100)}


def test_attach_is_whole_with_hot_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 1")
    got = attach(left, right, ["k"], "n", 5000)
    assert got.count() == 5000 and got.filter("n is null").count() == 500


def test_drop_near_copies_decides_by_row(spark):
    """A null or repeated id of a dropped row takes no clean row with it, and a group of null ids keeps one row."""
    near, alone, nulls = " ".join(f"a{k}" for k in range(300)), " ".join(f"b{k}" for k in range(300)), " ".join(f"c{k}" for k in range(300))
    rows = [(1, near), (None, near + "\n"), (2, near + "\n\n"), (2, alone), (None, "clean row without an id"), (None, nulls), (None, nulls + "\n")]
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == 4 and {(1, near), (2, alone), (None, "clean row without an id")} < set(got)


def jaccard_groups(texts):
    """Groups of numbers of texts by plain Jaccard similarity of all pairs that share a five-word shingle."""
    import re

    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower()) or (t or "").split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {""})
    holders: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    pairs = 0
    for k, s in enumerate(sets):
        shared: dict = {}
        for x in s:
            for m in holders[x]:
                if m < k:
                    shared[m] = shared.get(m, 0) + 1
        for m, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[m]) - n):
                pairs += 1
                a, b = root(k), root(m)
                up[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(texts))], pairs


def edited(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[k] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_drop_similar_against_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 120, 400]))) for _ in range(40)]
    for t in texts[:30]:
        texts += [edited(rng, t, rng.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(4)]
    chain = texts[3]
    for _ in range(12):
        texts.append(chain := edited(rng, chain, 0.015))
    texts += ["", None, " \n", "!!!", "???", "one", "One."]
    roots, pairs = jaccard_groups(texts)
    assert pairs > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_copies.drop_similar(docs).collect()) == sorted(set(roots))


def test_drop_similar_on_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    roots, _ = jaccard_groups([r["text"] for r in rows])
    got = near_copies.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted({rows[k]["doc_id"] for k in roots})


def test_texts_are_found_by_their_rarest_shingles(spark):
    """All pairs of which one looks and that are similar come out, whatever runs of shingles they share, and each once."""
    from halospark.llm import near_copies as N

    rng = random.Random(29)
    base = [[f"w{rng.randrange(4000)}" for _ in range(n)] for n in (40, 90, 90, 300)]
    base[2][:60] = base[1][:60]  # a passage of both
    texts = []
    for b in base:
        for k in range(30):
            t = list(b)
            for _ in range(k % 6 * len(b) // 300 + k % 2):
                t[rng.randrange(len(t))] = f"v{rng.randrange(9000)}"
            texts.append(" ".join(t[: len(t) - k % 5 * len(b) // 60]))
    of = N._Hashes()
    sets = [{int(h) for h in N._shingle_hashes(N._words(t), N.WORDS, of).view("int64")} for t in texts]
    found = [N.sketch(t, of) for t in texts]
    signed = lambda a: [int(v) for v in a.view("int64")]
    sketches = spark.createDataFrame([(i, f[0] - (f[0] >> 63 << 64), signed(f[2]), f[3]) for i, f in enumerate(found)], "node long, fp long, sig array<long>, size int")
    rows = spark.createDataFrame([(i, i // 2, sorted(s)) for i, s in enumerate(sets)], "node long, root long, set array<long>")
    own = [i for i in range(len(texts)) if i % 3]
    similar = lambda i, j: len(sets[i] & sets[j]) >= N.JACCARD * len(sets[i] | sets[j]) - 1e-9
    want = {(i, j) for j in range(len(texts)) for i in range(j) if (i % 3 or j % 3) and i // 2 != j // 2 and similar(i, j)}
    got = [tuple(r) for r in N._rare(spark.createDataFrame([(i,) for i in own], "node long"), rows, sketches).collect()]
    assert len(want) > 100 and want <= set(got) and len(got) == len(set(got))


def test_near_copies_are_searched_for_in_trees_of_fingerprints(spark):
    """In a shard of several groups each text meets one of its own group, and parts of a large shard are linked; texts of no group meet none."""
    from halospark.llm import near_copies as N

    rng = random.Random(31)
    texts = []
    for _ in range(4):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
        texts += [base] + [edited(rng, base, 0.005) for _ in range(5)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(6)]
    of = N._Hashes()
    signed = lambda a: [int(v) for v in a.view("int64")]
    sketches = spark.createDataFrame([(i, f[0] - (f[0] >> 63 << 64), signed(f[2]), f[3]) for i, f in enumerate(N.sketch(t, of) for t in texts)], "node long, fp long, sig array<long>, size int")
    shared = spark.createDataFrame([(i, 7, i) for i in range(len(texts))], "node long, key long, lone long").repartition(3)
    got = [tuple(r) for r in N._by_trees(shared, sketches).collect()]
    assert sorted(got) == [(i - i % 6, i) for i in range(24) if i % 6]
    large = spark.createDataFrame([(i, 7, i) for i in range(6)], "node long, key long, lone long")
    assert sorted(tuple(r) for r in N._by_trees(large, sketches, tree=2).collect()) == [(0, i) for i in range(1, 6)]
