import random
import re

import numpy as np

from tarnlake.llm import decontaminate as dc, queries


def plain_words(t):
    return re.findall(r"\w+", (t or "").lower())


def test_words_equal_a_pattern():
    texts = ["Ab c1, d-é!", "", "ÀÉ x—y “q”", "end", "start ", " w v", "_a_"]
    raw = [t.encode() for t in texts]
    h, upto = dc.words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    split = np.split(h, upto[:-1])
    seen = {}
    for t, own in zip(texts, split):
        ws = plain_words(t.replace("_", " "))
        assert len(ws) == len(own), t
        for w, x in zip(ws, own.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_lcs_equals_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert dc.lcs(np.array(a, int), np.array(b, int)) == t[-1][-1]


def test_singular_vectors_span_the_data():
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.normal(size=(dc.TERMS, 5)))[0]
    a = rng.normal(size=(300, 5)) * [9, 7, 5, 3, 2] @ basis.T
    c = a.T @ (a @ dc._omega(9, 3)[: dc.TERMS].astype(float))
    got = dc.singular_vectors(c, 5)
    s = np.linalg.svd(a, compute_uv=False)[:5]
    assert got.shape == (dc.TERMS, 5)
    assert np.allclose(np.linalg.norm(a @ got, axis=0), 1, atol=1e-3) and np.allclose(1 / np.linalg.norm(got, axis=0), s, rtol=1e-3)


def pool(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_planted_copies_paraphrases_and_decoys(spark):
    rng = random.Random(6)
    words = pool(rng, 3000)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(6, 70))) for i in range(40)] + [(100, None), (101, ""), (102, "two words"), (0, "again " + text(20))]
    docs, want = [], set()
    for d in range(400):
        body = text(rng.randint(20, 400)).split()
        if d % 4 == 0:
            i, t = items[rng.randrange(40)]
            ws = t.split()
            if d % 8 == 0 and len(ws) >= 20:  # a paraphrase: every eighth word is another one
                ws = [rng.choice(words) if k % 8 == 3 else w for k, w in enumerate(ws)]
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in ws]
            want.add((d, i))
        elif d % 4 == 1:  # a decoy: a quarter of an item
            ws = items[rng.randrange(40)][1].split()
            body[5:5] = ws[: len(ws) // 4]
        docs.append((d, " ".join(body), "x", 1.0))
    docs += [(400, None, "x", 1.0), (401, "", "x", 1.0), (402, "w " * 60000, "x", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, cosine double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(df, bench).collect()}
    assert got == want
    assert dc.matches(df.limit(0), bench).count() == 0 and dc.matches(df, bench.limit(0)).count() == 0


def test_query_finds_every_verbatim_item(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    items = {r.item_id: " ".join(plain_words(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in docs for t in [" ".join(plain_words(r.text))] for i, y in items.items() if y in t}
    got = {(r.doc_id, r.item_id) for r in queries.op3_latent_decontamination(spark, d).collect()}
    assert got == want and want


def test_short_items_match_as_whole_sequences(spark):
    docs = spark.createDataFrame([(1, "so Blue whale, here"), (2, "whale blue"), (3, "blue whales"), (4, None), (5, "a blue"), (6, "whale b. Blue whale blue whale")], "doc_id long, text string")
    long = "one two three four five six seven eight nine ten"
    for more in ([], [(9, long)]):
        items = spark.createDataFrame([(7, "blue whale"), (8, "blue whale"), (2, "!"), (3, None), *more], "item_id long, text string")
        got = sorted((r.doc_id, r.item_id) for r in dc.matches(docs, items).collect())
        assert got == [(1, 7), (1, 8), (6, 7), (6, 8)]
    assert dc.matches(docs.limit(0), items).count() == 0


def test_paraphrases_that_the_exact_rule_accepts_are_candidates(spark):
    """Items with replaced and inserted words between strange ones; what a full common subsequence with the paraphrase accepts must be found."""
    import random
    import re

    d = "/root/testdata/sf0.01"
    benchmark = spark.read.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    pool = [w for r in docs.where("length(text) > 100").limit(200).collect() for w in re.findall(r"\w+", r.text)]
    strange = lambda n: [rng.choice(pool) for _ in range(n)]

    def ids(words):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        return dc._id(dc.words_of(raw, np.array([len(raw)]))[0])

    rows, want = [], []
    for share, inserted in ((0.1, 0.0), (0.2, 0.2), (0.3, 0.0), (0.35, 0.1), (0.4, 0.0)):
        for r in benchmark.collect():
            words, out = re.findall(r"\w+", r.text), []
            for k, w in enumerate(words):
                answer = k >= len(words) - max(3, len(words) // 5)
                out += [rng.choice(pool) if not answer and rng.random() < share else w]
                out += strange(1) if not answer and rng.random() < inserted else []
            a, b = ids(words), ids(out)
            part, told = dc.lcs(a, b) / len(a), dc.lcs(dc.answer_of(a), b) >= 0.8 * len(dc.answer_of(a))
            rows.append((10**9 + len(rows), " ".join([*strange(40), *out, *strange(40)])))
            if part >= 0.8 or part >= 0.6 and told:
                want.append((rows[-1][0], r.item_id))
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(docs.unionByName(more), benchmark).collect()}
    assert len(want) > 60 and np.mean([w in got for w in want]) > 0.97


def test_parts_of_a_large_benchmark(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    short = spark.createDataFrame([(-1, docs.where("length(text) > 0").first().text.split()[0])], "item_id long, text string")
    items = items.select("item_id", "text").unionByName(items.select("item_id", "text").limit(3)).unionByName(short)
    rows = lambda **k: sorted((r.doc_id, r.item_id, r.lcs_share, r.answer_found) for r in dc.matches(docs, items, **k).collect())
    whole = rows()
    assert whole and rows(most_items=20) == whole and rows(most_bytes=2000) == whole
