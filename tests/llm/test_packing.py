import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as some
from tokenizers import Tokenizer

from tarnlake.llm import packing, queries

FILE = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity=4096):
    tok = Tokenizer.from_file(FILE)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for d, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(by[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            cut = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(cut) == r.length and zlib.crc32(cut.tobytes()) == r.ids_crc32
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in free if s >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(some.lists(some.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    h = {n: lengths.count(n) for n in lengths}
    rows = packing.plan(h, 40)
    bins, ranks = {}, {}
    for length, first, n, seq, each, offset in rows.tolist():
        for q in range(n):
            bins.setdefault(seq + q // each, []).append((offset + q % each * length, length))
            ranks.setdefault(length, []).append(first + q)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in h.items()}
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 40
    assert len(bins) == best_fit(lengths, 40)


def test_chunks_equal_whole_texts():
    tok, ids = Tokenizer.from_file(FILE), packing.Ids(FILE, most=50)
    rng = random.Random(1)
    letters = "aBİ.,\x1c é́  \t\n\r\x0b\x0c'<|endoftext|>ſΣς12..!!’\x85\x1c　日本"
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|> x", "it's we'll 'S"])
        assert ids.many([t, "x."])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_edges(spark, docs_of):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "same text", 5: "same text", 6: "x", 7: "a" * 20000}
    rows = packing.pack(docs_of(list(texts.items())), FILE).collect()
    check(rows, texts)
    twice = packing.pack(docs_of([(1, "a b"), (1, "a b")]), FILE).collect()
    assert len(twice) == 2 and len({r.sequence_id for r in twice}) == 1
    assert packing.pack(docs_of([]), FILE).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op1_best_fit_packing(spark, d).collect()
    assert check(rows, texts) == best_fit([r.length for r in rows], 4096)
