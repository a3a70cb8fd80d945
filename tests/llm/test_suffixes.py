import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from tarnlake.llm import queries, suffixes
from tarnlake.llm.common import Scratch, remove


def plain(texts, length=200):
    """One row per text, in order, from a dictionary of all strings of that length."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11])
def test_cover(q):
    v, d = suffixes.difference_cover(q)
    assert v == q * q + q + 1 and len(d) == q + 1 and {(i - j) % v for i in d for j in d} == set(range(v))


@pytest.mark.parametrize("length", [5, 12, 40, 200])
def test_bucket_is_sorted_by_its_text(length):
    rng = random.Random(length)
    for _ in range(10):
        base = bytes(rng.choice(b"abc") for _ in range(800)) * 2
        pieces = [b"z" * (length + 100)]
        for _ in range(rng.randint(1, 40)):
            a = rng.randrange(400)
            p = bytearray(base[a : a + length + rng.randint(0, 150)])
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = 120
            pieces.append(bytes(p))
        pieces = list(dict.fromkeys(pieces))
        text, at, seen = b"".join(pieces), [], {}
        for p in pieces:
            start = at[-1] + length if at else 0
            at += range(start, start + len(p) - length + 1)
            for i in range(len(p) - length + 1):
                seen[p[i : i + length]] = seen.get(p[i : i + length], 0) + 1
        at = np.array(at)
        order, same = suffixes.Bucket(np.frombuffer(text, np.uint8), at, length).sorted()
        strings = [text[i : i + length] for i in at[order].tolist()]
        assert strings == sorted(strings)
        assert same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]
        marks = suffixes.sort_bucket(pieces + pieces[:1], np.zeros(len(pieces) + 1), length)
        for k, p in enumerate(pieces):
            assert marks[k].tolist() == [k == 0 or seen[p[i : i + length]] > 1 or p[i : i + length] in pieces[0] for i in range(len(p) - length + 1)]


def test_frequent_lines_in_many_contexts(spark):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(rng.choice("stuvwxyz ") for _ in range(rng.randint(20, 260))) + line + "".join(rng.choice("stuvwxyz ") for _ in range(rng.randint(20, 260))) for _ in range(300)]
    texts += [texts[7][5:], texts[8][:-3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated(df, chunk_bytes=9000, bucket_bytes=8000).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    # around the line, what stands beside it decides the bucket
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts[:300]]
    rounds = suffixes.Rounds(200, (8, 64))
    most = []
    for hot in (None, np.unique(suffixes.Text(np.frombuffer(line.encode(), np.uint8), np.array([150]), rounds.powers).grams(16))):
        r, load = suffixes.Rounds(200, (8, 64), hot=hot), np.zeros(64)
        for d in data:
            t = suffixes.Text(d, np.array([len(d)]), r.powers)
            for bucket, blob, _, _ in r.runs(t, np.arange(max(0, len(d) - 199))).blobs():
                load[bucket] += len(blob)
        most.append(load.max() / load.sum())
    assert most[1] < most[0] / 2


def test_edges_of_frequent_passages(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = ["".join(rng.choice("stuvwxyz ") for _ in range(rng.randint(20, 220))) + passage + "".join(rng.choice("stuvwxyz ") for _ in range(rng.randint(20, 220))) for _ in range(300)]
    texts += [texts[7][5:], texts[8][:-3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated(df, chunk_bytes=9000, bucket_bytes=8000).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    # suffixes that reach over an edge by less than the way to the next anchor do not all meet at a gram of the passage
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts[:300]]
    counts = Counter()
    for t in texts[:300]:
        x = suffixes.Text(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), suffixes.Powers(0))
        counts.update(x.grams(16).tolist())
    often = np.sort(np.array([g for g, n in counts.items() if n > 40], np.uint64))
    r, load = suffixes.Rounds(200, (8, 1 << 20), hot=often, worn=often), Counter()
    for d in data:
        t = suffixes.Text(d, np.array([len(d)]), r.powers)
        for bucket, blob, heads, _ in r.runs(t, np.arange(max(0, len(d) - 199))).blobs():
            stop = np.cumsum(np.frombuffer(heads, suffixes.PIECE)["size"])
            for z, n in zip(stop.tolist(), np.diff(stop, prepend=0).tolist()):
                load[bucket, blob[z - n : z]] = n
    by_bucket = Counter()
    for (bucket, _), n in load.items():
        by_bucket[bucket] += n
    assert max(by_bucket.values()) < 40 * 400


def test_a_bucket_of_much_text_is_sorted_in_bounded_memory():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 101, 1 << 19, dtype=np.uint8).tobytes()
    rows = []
    for seq in range(500):
        own = [base[a : a + 299] for a in rng.integers(0, len(base) - 300, 30).tolist()]
        part = [x[100] << 8 | x[101] for x in own]  # texts of one part or another
        heads = np.array([(len(x), p) for x, p in zip(own, part)], [("size", "<i4"), ("part", "<u2")])
        rows.append((0, seq, 1, b"".join(own), heads.tobytes(), np.packbits(np.zeros(30, bool)).tobytes()))
    pdf = pd.DataFrame(rows, columns=["part", "seq", "bucket", "texts", "sizes", "many"])
    tracemalloc.start()
    out = suffixes._answer_pieces(200)(pdf)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(out["seq"]) == list(range(500)) and most < 40 * 500 * 30 * 299


@pytest.mark.parametrize("most", [1, 3000, 1 << 20])
def test_parts_equal_the_whole(monkeypatch, most):
    rng = random.Random(most)
    pieces, part = [], []
    for _ in range(200):
        p = rng.randrange(9)  # equal suffixes are of one part, as a letter of their own shows
        pieces.append(("".join(rng.choice("xy") for _ in range(4)) * 20)[: rng.randint(40, 70)].replace("x", "abcdefghi"[p]).replace("y", "ABCDEFGHI"[p]).encode())
        part.append(p)
    many = np.array([rng.random() < 0.1 for _ in pieces])
    want = suffixes.sort_bucket(pieces, many, 40)
    monkeypatch.setattr(suffixes, "SORTED_BYTES", most)
    got = suffixes.sort_in_parts(pieces, np.array(part, np.uint16), many, 40)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_a_large_split_is_read_a_few_chunks_at_a_time(spark):
    """However much one task is given, a row group holds few chunks and a part's answers are of few."""
    texts = [chr(97 + k % 26) * 1000 for k in range(100)]
    tmp = Scratch(spark, "suffixes-test")
    chunks, name = suffixes.chunked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tmp, "doc_id", "text", 1000)
    try:
        rows = chunks.select("part", "seq", "ids", "data").collect()
        assert len({(r.part, r.seq) for r in rows}) == len(rows) == 100
        assert {i: bytes(r.data).decode() for r in rows for i in r.ids} == dict(enumerate(texts))
        assert max(Counter(r.part for r in rows).values()) <= 8
        held = [pq.read_metadata(f.removeprefix("file://")) for f in chunks.inputFiles()]
        assert max(m.row_group(g).num_rows for m in held for g in range(m.num_row_groups)) <= 4
    finally:
        spark.sql(f"DROP TABLE {name}")
        remove(spark, tmp.root)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abé ") for _ in range(6000))
    texts = [None, "", "short", "z" * 1000, "é" * 300]
    for _ in range(60):
        t = ""
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(6000)
            t += base[a : a + rng.choice([20, 90, 150, 199, 200, 201, 260, 420, 900])] + "".join(rng.choice("xy") for _ in range(rng.choice([0, 1, 40])))
        texts.append(t)
    texts += [texts[10], texts[10], base]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, seq int, part string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated(df, chunk_bytes=3000, bucket_keys=500).collect()}
    want = plain(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i], w)


def test_other_lengths(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (5, 12, 40):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated(df, length=length).collect()}
        assert [got[i] for i in range(30)] == plain(texts, length)


def test_edges(spark, docs_of):
    assert suffixes.repeated(docs_of([])).count() == 0
    rows = suffixes.repeated(docs_of([(1, None), (1, None), (2, "x" * 199), (3, "x" * 199)])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(1, 0, 0), (1, 0, 0), (2, 199, 0), (3, 199, 0)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_repeats(spark, d).collect()}
    assert got == want
