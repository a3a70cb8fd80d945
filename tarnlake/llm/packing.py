"""Best-fit packing planned on the length histogram.

One pass over the texts makes ids and cuts documents into pieces; only lengths
and checksums are kept.  The plan is made on counts: lengths from long to short
are placed best-fit into groups of sequences with equal free space, so its cost
depends on the sequence length (at most 4096 histogram rows), never on the number
of documents.  Pieces then get a rank within their length, from a local counter
and the counts of earlier tasks, and take the planned slot of that rank.

Edge cases: null and empty texts are one piece holding the end id; pieces of
equal length are interchangeable and ranked in any fixed order; repeated rows
are packed again each; an empty table packs into nothing; a null id is kept.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, part int, rank long"


class Ids:
    """Whole texts to ids, chunk by chunk.

    The vocabulary's splitter never crosses white space, so a text's ids are
    those of its white-space chunks in turn; chunks recur, and each distinct one
    is encoded once.  A chunk of letters and closing marks is put together from
    both; letters are encoded many words at a time and cut after the ids that end
    a word.  The memory of chunks is bounded and starts anew when full.
    """

    def __init__(self, tokenizer_file: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core; threads would each keep memory
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer_file)
        self.encode = made.encode_batch_fast
        vocabulary = made.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known = _Slots()
        self.flat = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _put(self, chunks: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        slot = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        n = len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.known) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + n] = ids
        self.first[slot] = self.used + np.cumsum(sizes) - sizes
        self.size[slot] = sizes
        self.used += n

    def _learn_each(self, chunks: list[str]) -> None:
        got = [e.ids for e in self.encode(chunks, add_special_tokens=False)]
        self._put(chunks, np.fromiter(map(len, got), np.int64, len(got)), np.array([i for g in got for i in g], np.uint32))

    def _learn_words(self, words: list[str], run: int = 1000) -> None:
        """Chunks of letters alone: one word each, unless lower case makes marks of a letter."""
        runs = [words[at : at + run] for at in range(0, len(words), run)]
        for own, e in zip(runs, self.encode([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(own):
                self._put(own, np.diff(ends, prepend=0), ids)
            else:
                self._learn_each(own)

    def _learn(self) -> None:
        """Fill the slots of chunks that were new."""
        fresh = self.known.fresh
        words, other, joined = [], [], []
        for c in fresh:  # grows while it is read: parts of a chunk may be new themselves
            if c.isalpha() and (c.isascii() or c.lower().isalpha()):
                words.append(c)
                continue
            base = c.rstrip(_MARKS)
            if base and base != c and base.isalpha() and (base.isascii() or base.lower().isalpha()):
                joined.append((c, self.known[base], self.known[c[len(base) :]]))
            else:
                other.append(c)
        self.known.fresh = []
        if words:
            self._learn_words(words)
        if other:
            self._learn_each(other)
        if joined:
            both = np.array([j[1:] for j in joined], np.int64)
            self._put([j[0] for j in joined], self.size[both].sum(1), self._gather(both.ravel()))

    def _gather(self, slot: np.ndarray) -> np.ndarray:
        size = self.size[slot]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.first[slot] - (ends - size), size)]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.most:
            self.clear()
        slots = []
        for t in texts:
            chunks = _chunks(t)
            slots.append(np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks)))
        if self.known.fresh:
            self._learn()
        return [self._gather(s) if len(s) else np.zeros(0, np.uint32) for s in slots]

    @classmethod
    def of_worker(cls, tokenizer_file: str) -> Ids:
        """The one of this worker process, whose memory later tasks find filled."""
        import tokenizers

        kept = vars(tokenizers).setdefault("_ids_of_worker", {})
        if tokenizer_file not in kept:
            kept[tokenizer_file] = cls(tokenizer_file)
        return kept[tokenizer_file]


class _Slots(dict):
    """Chunk to slot; a new chunk gets the next slot and waits in ``fresh`` to be learned."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


#: Marks that follow letters; none joins with a letter, and an apostrophe is not among them.
_MARKS = ".,;:!?*#$%&)]"
_BLANKS = str.maketrans("\t\n\r", "   ")
_NO_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the splitter


def _chunks(text: str) -> list[str]:
    if _NO_SPACE.search(text):
        return [c for c in text.translate(_BLANKS).split(" ") if c]
    if text.isascii() and "<|" not in text:
        text = text.lower()
    return text.split()


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank among its length within its task (part)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.of_worker(tokenizer_file)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows, piece, crc, size = [], [], [], []
            for k, x in enumerate(ids.many([t or "" for t in b.column(1).to_pylist()])):
                x = memoryview(np.append(x, np.uint32(end_id)).astype("<u4", copy=False))
                for p, at in enumerate(range(0, len(x), capacity)):
                    cut = x[at : at + capacity]
                    rows.append(k)
                    piece.append(p)
                    size.append(len(cut))
                    crc.append(zlib.crc32(cut))
            if rows:
                p, n = np.array(piece, np.int32), np.array(size, np.int64)
                order = np.argsort(n, kind="stable")
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - np.searchsorted(n[order], n[order])
                rank += seen[n]
                seen += np.bincount(n, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(p), pa.array(p * np.int64(capacity)), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(p), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES.format(kind))


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts.

    Rows (length, first rank, ranks, first sequence, items per sequence, offset):
    ranks from the first on fill the sequences in turn, so many items in each,
    from that offset.  Sequences with equal free space are one group of ranges;
    an item goes to the smallest free space that holds it, and the same space
    stays the best fit until it holds no more.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    sequences, rows = 0, []
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        for space in sorted(s for s in free if s >= length):
            if not left:
                break
            each = space // length
            ranges, free[space] = free[space], []
            while ranges and left:
                first, n = ranges.pop()
                full = min(n, left // each)
                if full:
                    rows.append((length, rank, full * each, first, each, capacity - space))
                    rank, left = rank + full * each, left - full * each
                    free.setdefault(space - each * length, []).append((first, full))
                if full < n and left and left < each:
                    rows.append((length, rank, left, first + full, left, capacity - space))
                    free.setdefault(space - left * length, []).append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    ranges.append((first + full, n - full))
            free[space] += ranges
            if not free[space]:
                del free[space]
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                rows.append((length, rank, full * each, sequences, each, 0))
                free.setdefault(capacity - each * length, []).append((sequences, full))
            if rest:
                rows.append((length, rank + full * each, rest, sequences + full, rest, 0))
                free.setdefault(capacity - rest * length, []).append((sequences + full, 1))
            sequences += full + bool(rest)
        free.pop(0, None)
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    tmp = Scratch(docs.sparkSession, "packing")
    made = tmp.write(pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col), "pieces")
    counts = made.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = tmp.write(counts.withColumn("base", F.coalesce(before, F.lit(0))), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    # Sorted by (length, first rank): one number finds a piece's row. The plan's size depends on the capacity alone.
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = docs.sparkSession.sparkContext.broadcast(slots[order])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        lengths, starts = np.unique(s[:, 0], return_index=True)
        stops = np.append(starts[1:], len(s))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = np.empty(len(length), np.int64)
            at = np.searchsorted(lengths, length)
            for k in np.unique(at):
                own = at == k
                row[own] = starts[k] + np.searchsorted(s[starts[k] : stops[k], 1], rank[own], "right") - 1
            turn = rank - s[row, 1]
            sequence, offset = s[row, 3] + turn // s[row, 4], s[row, 5] + turn % s[row, 4] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = made.join(counts.select("length", "part", "base").hint("merge"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(take, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
