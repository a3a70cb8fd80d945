import random

import numpy as np
import pytest
import xxhash

from tarnlake.llm import queries, simhash_trie as st


def plain(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_trie_links_equal_brute_force():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    xs = list(base)
    for _ in range(900):
        x = rng.choice(xs)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        xs.append(x)
    f = np.unique(np.array(xs, np.uint64))
    want = components(dict(enumerate(map(int, f))))
    pairs = st.trie_links(f, 2, leaf=4)
    parent = list(range(len(f)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        assert bin(int(f[a] ^ f[b])).count("1") <= 2
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(f))] == [want[i] for i in range(len(f))]


def test_hot_root_grows(spark):
    from tarnlake.llm.common import Scratch
    from tarnlake.llm.components import connected

    rng = random.Random(5)
    xs = {rng.getrandbits(22) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}
    xs = sorted({int(np.uint64(x).view(np.int64)) for x in xs})
    df = spark.createDataFrame([(x,) for x in xs], "fp long")
    tmp = Scratch(spark, "t")
    got = {r.node: r.root for r in connected(st.links(df, tmp, limit=16), tmp).collect()}
    want = components({i: x & (2**64 - 1) for i, x in enumerate(xs)})
    for i, x in enumerate(xs):
        assert got.get(x, x) == xs[want[i]]


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "x " * 30000), (7, "one two three four"), (7, "one two three four"), (8, "É é ÉÉ")]
    out = {(r.doc_id, r.fp, r.component_id) for r in st.near_duplicates(docs_of(rows)).collect()}
    by = {d: (f, c) for d, f, c in out}
    assert {d: f & (2**64 - 1) for d, (f, _) in by.items()} == {d: plain(t) for d, t in rows}
    assert {d: c for d, (_, c) in by.items()} == {d: components({i: plain(t) for i, t in rows})[d] for d, _ in rows}
    assert st.near_duplicates(docs_of([])).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain(r.text) for r in rows}
    want = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_trie(spark, d).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_near_copies_by_similarity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    texts, group = [], []
    for g in range(60):
        base = [word() for _ in range(rng.randint(60, 500))]
        for k in range(rng.randint(1, 4)):
            ws = list(base)
            for _ in range(len(ws) // 100 * (k > 0)):  # a word in a hundred: similarity about 0.9
                ws[rng.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
            group.append(g)
    n = len(texts)
    texts += [None, "", " ", "x", "x", texts[0]]
    df = spark.createDataFrame([(i, t, "w", 0) for i, t in enumerate(texts)], "doc_id long, text string, wide string, fp int")
    rows = st.near_copies(df).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(texts) and got[n] == n and got[n + 1] == n + 1 and got[n + 4] == n + 3 and got[n + 5] == got[0]
    first = {g: group.index(g) for g in group}
    assert all(got[i] == first[g] or got[i] == i or group[got[i]] == g for i, g in enumerate(group))  # no clean text is linked
    assert np.mean([got[i] == first[g] for i, g in enumerate(group)]) > 0.95
    assert st.near_copies(df.limit(0)).count() == 0


def shingles(text, words=5):
    ws = text.split()
    return {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_groups(sets, least=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("bounds", [None, (1 << 14, 40_000), (16, 10_000)])
def test_copies_within_a_family_of_templates(spark, monkeypatch, bounds):
    """Texts of one template are near each other below 0.8; the copies among them are found all the same, in blocks too."""
    if bounds:
        monkeypatch.setattr(st, "ROOT_ROWS", bounds[0])
        monkeypatch.setattr(st, "FAMILY_BYTES", bounds[1])
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    frame, texts = [word() for _ in range(250)], []
    for _ in range(150):
        own = frame[:125] + [word() for _ in range(40)] + frame[125:]
        texts.append(" ".join(own))
        for _ in range(rng.randint(0, 2)):
            ws = list(own)
            for _ in range(2):
                ws[rng.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    rng.shuffle(texts)
    want = brute_groups([shingles(t) for t in texts])
    got = {r.doc_id: r.component_id for r in st.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 100 < len(set(want)) < len(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    """One chain of texts, each like the next alone, and a clique: both end as one component, whatever the blocks."""
    monkeypatch.setattr(st, "ROOT_ROWS", 32)
    monkeypatch.setattr(st, "FAMILY_BYTES", 20_000)
    chain = [" ".join(f"w{k + 6 * i}" for k in range(60)) for i in range(40)]
    clique = [" ".join([f"v{k}" for k in range(200)] + [f"own{i}"]) for i in range(200)]
    texts = [t for pair in zip(chain, clique) for t in pair] + clique[40:]
    want = brute_groups([shingles(t) for t in texts])
    got = {r.doc_id: r.component_id for r in st.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and set(want) == {0, 1}


def test_tries_grow_with_the_table():
    assert st.tries_for(2) == st.tries_for(1 << 20) == (12, 40)
    tops = [st.tries_for(1 << k) for k in range(20, 40)]
    assert tops == sorted(tops) and tops[-1] == (31, st.tries_for(1 << 39)[1]) and tops[-1][1] < 1000
    assert (st._drawn(3) == st._drawn(5)[:3]).all()


def test_near_copies_equal_all_pairs(spark):
    """Every pair of the table by its whole shingle sets."""
    from collections import Counter, defaultdict

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: {" ".join(s) for s in shingles_of(r.text)} for r in docs.collect()}
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in holders[s])
        for j, n in both.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    got = {r.doc_id: r.component_id for r in st.near_copies(docs).collect()}
    want = {i: find(i) for i in sets}
    assert pairs > 20 and all(want[got[i]] == want[i] for i in got)  # nothing else is linked
    assert sum(got[i] == want[i] for i in got if want[i] != i) >= 0.99 * sum(want[i] != i for i in got)


def shingles_of(text):
    ws = [w.decode() for w in (text or "").encode().lower().split()]
    return [ws[i : i + 5] for i in range(max(1, len(ws) - 4))] if ws else []


def test_alike_equals_brute_force():
    rng = np.random.default_rng(4)
    base = [rng.choice(5000, rng.integers(1, 300), replace=False) for _ in range(30)]
    sets = [np.unique(np.append(rng.permutation(b)[: int(len(b) * rng.uniform(0.75, 1))], rng.choice(5000, rng.integers(1, 2 + len(b) // 8)))) for b in base for _ in range(6)]
    want, got = brute_groups([set(s.tolist()) for s in sets]), list(range(len(sets)))
    for g in st.alike([s.astype(np.uint64) for s in sets], 0.8):
        for i in g:
            got[i] = min(g)
    assert got == want and len(set(got)) < len(sets)


def test_isolated_pairs_near_the_threshold_are_found(spark):
    rng, n = np.random.default_rng(6), 0
    texts, alike = [], []
    for size in (12, 40, 304):
        for _ in range(250):
            a, n = [f"w{n + k}" for k in range(size)], n + size
            b = a[: size - int(rng.integers(1, size // 4))]
            s = jaccard(shingles(" ".join(a)), shingles(" ".join(b)))
            texts += [" ".join(a), " ".join(b)]
            alike.append(s)
    got = {r.doc_id: r.component_id for r in st.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = np.array([got[2 * k] == got[2 * k + 1] for k in range(len(alike))])
    s = np.array(alike)
    assert not found[s < 0.8].any()
    assert found[(s >= 0.8) & (s < 0.85)].mean() > 0.98 and found[s >= 0.85].mean() > 0.99


def test_null_id_among_copies(spark, docs_of):
    text = "one two three four five six seven"
    rows = st.near_copies(docs_of([(None, text), (4, text), (3, text), (9, "quite another text of a few words")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 3), (3, 3), (4, 3), (9, 9)]
