"""Benchmark decontamination by latent semantic retrieval, then order-aware confirmation.

1. Items of the benchmark are cut into segments of at most 64 words, and taken in blocks of ``SEGMENTS``, so that a
   benchmark of any size is compared with all rows, block by block. Documents become arrays of the block's term
   numbers, once. Document frequencies are counted over all documents.
2. A randomised SVD gives the latent space: a random matrix is multiplied by A'A in passes over the TF-IDF passages of all
   documents and made orthogonal; a small eigenproblem turns the basis. The segments are
   rows of A too, with ``ITEM_WEIGHT`` that grows with the words, so the space keeps the directions that the queries lie in.
3. Every window of two adjacent passages of ``PASSAGE`` words of every document is projected; windows with a cosine of ``COSINE`` or more to a
   segment are candidates. No number of candidates is capped.
4. So is every run of four passages (two, for segments of up to ``SHORT`` words) that holds so many of a segment's words that ``LIKELY`` of them can be there (``WordBound``),
   however common the words are: a stretch as below always lies in such a run, so no leak depends on the fit of the space.
5. A candidate is confirmed by the longest common subsequence of words with the segment, in stretches half as long
   again as the segment: a share of ``SURE`` or more is a leak; a paraphrase with ``LIKELY`` or more is one if its
   answer, the segment's last sentence or at least its last five words, is there too (``ANSWER`` of its words in order).

Words have no case and end at white space and ASCII punctuation. Edge cases: null or empty texts match nothing; segments of fewer than
``LEAST_WORDS`` words are no evidence and match nothing; null ids are returned as null; rows that repeat id and text
appear once; equal items are all reported; an empty table or benchmark gives no rows. Columns beside the id and the
text are not read. A term that more than a tenth of the documents have carries no weight in the latent space, unless an item
has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import stored, text_key, without
from tabsmith.llm.words import WHITE, slices, words

SEGMENTS = 256
SEGMENT_WORDS = 64
LEAST_WORDS = 5
PASSAGE = 32
CHUNK = 1 << 15
"""Words of a document in one row of term numbers; the next row repeats the last ``MARGIN`` words."""
MARGIN = 128
RANK = 64
TERMS = 128
"""Terms whose sums over tasks are added up together."""
ITEM_WEIGHT, ITEM_WORDS = 10.0, 4_000_000
"""Weight of the items beside passages of so many words; beyond, it grows so that their share of A'A stays."""
COSINE = 0.4
WINDOW = 4 * PASSAGE
SHORT = 21
"""Stretches of segments of so many words lie in two passages."""
PAIRS = 8192
"""Candidates are confirmed in batches of about so many."""
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8
BREAKS = WHITE | np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
SENTENCE_ENDS = np.isin(np.arange(256), list(b".?!\n"))


@dataclass
class Segment:
    item: int
    """Row number of the item in its block."""
    words: np.ndarray
    answer: int
    """First word of the answer."""


def segments(texts: pa.Array) -> list[Segment]:
    """The segments of the items' texts that have enough words."""
    out = []
    for w in words(texts, breaks=BREAKS):
        ends = np.concatenate(([0], np.cumsum(SENTENCE_ENDS[w.buffer])))
        for i in range(w.texts):
            lo, hi = int(w.begin[i]), int(w.begin[i + 1])
            parts = -(-(hi - lo) // SEGMENT_WORDS)
            for a, b in zip(edges := [lo + (hi - lo) * k // max(1, parts) for k in range(parts + 1)], edges[1:]):
                if b - a >= LEAST_WORDS:
                    after = ends[w.start[a + 1 : b]] > ends[w.end[a : b - 1]]  # a sentence begins at the word
                    last = int(np.flatnonzero(after)[-1]) + 1 if after.any() else 0
                    out.append(Segment(w.first + i, w.hash[a:b].copy(), min(last, b - a - LEAST_WORDS)))
    return out


def encode(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, text_key, terms): 16-bit term numbers of a document's words, the vocabulary's size for other words."""
    none = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(2), breaks=BREAKS):
                at = np.searchsorted(vocabulary, w.hash)
                terms = np.where(vocabulary[np.minimum(at, none - 1)] == w.hash, at, none).astype(np.uint16)
                rows, data = [], []
                for i in range(w.texts):
                    lo, hi = w.begin[i], w.begin[i + 1]
                    for a in range(lo, hi, CHUNK):
                        rows.append(w.first + i)
                        data.append(terms[a : min(hi, a + CHUNK + MARGIN)].tobytes())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(data, pa.binary())], ["doc_id", "text_key", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, terms binary")


def _terms(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_py(), np.uint16).astype(np.int64)


def frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows that have each term, times that each occurs, rows, and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * size + 3, np.int64)
        for batch in batches:
            for terms in _terms(batch.column(0)):
                times = np.bincount(terms, minlength=size + 1)
                counts[:size] += times[:size] > 0
                counts[size : 2 * size + 1] += times
                counts[2 * size + 1] += 1
                counts[2 * size + 2] += len(terms)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "count"])

    sums = encoded.select("terms").mapInArrow(run, "term long, count long").groupBy("term").agg(F.sum("count").alias("count")).collect()
    out = np.zeros(2 * size + 3, np.int64)
    for r in sums:
        out[r["term"]] = r["count"]
    return out[:size], out[size : 2 * size], int(out[2 * size + 1]), int(out[2 * size + 2])


def passage_sums(terms: np.ndarray, table: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over the words of each passage."""
    out = np.zeros((max(1, -(-len(terms) // PASSAGE)), table.shape[1]), table.dtype)
    used = np.flatnonzero(weighted[terms])
    if len(used):
        passage = used // PASSAGE
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        out[passage[first]] = np.add.reduceat(table[terms[used]], first, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def passages(encoded: DataFrame, weights: np.ndarray) -> DataFrame:
    """(term, count, size) of passages of ``2 * PASSAGE`` words, some in a row: each weighted term with its times, and the terms of each passage."""
    size, length = len(weights), 2 * PASSAGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = np.append(weights > 0, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0).cast(pa.large_binary())
            _, at, data = column.buffers()
            offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
            for a, b in slices(offsets):
                terms = np.frombuffer(data, np.uint16, (offsets[b] - offsets[a]) // 2, offsets[a])
                used = np.flatnonzero(weighted.take(terms))
                if not len(used):
                    continue
                begin = (offsets[a : b + 1] - offsets[a]) // 2
                whole = -(-np.diff(begin) // length)
                row = np.searchsorted(begin, used, "right") - 1
                passage = (np.cumsum(whole) - whole)[row] + (used - begin[row]) // length
                pair, count = np.unique(passage * size + terms[used], return_counts=True)
                _, each = np.unique(pair // size, return_counts=True)
                columns = [(pair % size).astype(np.uint16), count.astype(np.uint8), each.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["term", "count", "size"])

    return encoded.select("terms").mapInArrow(run, "term binary, count binary, size binary")


def _normal_product(rows: DataFrame, weights: np.ndarray, items: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis: one pass over ``passages``, and the weighted items' own rows."""
    size, rank = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, columns = np.zeros((rank, size)), np.ascontiguousarray(basis.T)
        for batch in batches:
            for block in zip(*batch.columns):
                term, count, each = (np.frombuffer(v.as_buffer(), t) for v, t in zip(block, (np.uint16, np.uint8, np.uint8)))
                term, passage = term.astype(np.intp), np.repeat(np.arange(len(each)), each)
                first = np.cumsum(each, dtype=np.int64) - each
                value = count * weights.take(term)
                value /= np.sqrt(np.add.reduceat(value * value, first)).take(passage)
                for j in range(rank):
                    product = np.add.reduceat(value * columns[j].take(term), first)
                    total[j] += np.bincount(term, value * product.take(passage), size)
        parts = [i for i in range(0, size, TERMS) if total[:, i : i + TERMS].any()]
        sums = [total[:, i : i + TERMS].tobytes() for i in parts]
        task = [TaskContext.get().partitionId()] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(task, pa.int32()), pa.array(sums, pa.binary())], ["part", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in table.sort_by("task")["sums"])
        return pa.table([table["part"][:1], pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    parts = rows.mapInArrow(run, "part int, task int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()  # one matrix
    out = items.T @ (items @ basis)
    for r in parts:
        out[r["part"] : r["part"] + TERMS] += np.frombuffer(r["sums"]).reshape(rank, -1).T
    return out


def latent_space(rows: DataFrame, weights: np.ndarray, items: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the weighted passages, by a randomised range finder with one power step."""
    rank = min(rank, len(weights))
    basis = np.random.default_rng(seed).standard_normal((len(weights), min(len(weights), rank + 8)))
    for _ in range(2):
        basis, _ = np.linalg.qr(_normal_product(rows, weights, items, basis))
    _, turn = np.linalg.eigh(basis.T @ _normal_product(rows, weights, items, basis))
    return basis @ turn[:, ::-1][:, :rank]


def common_words(text: np.ndarray, masks: np.ndarray, segment: np.ndarray, length: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    """Length of the longest common subsequence of each text row and its segment, a bit per segment word.

    ``masks[segment, term]``: the segment's words that are the term. ``used``: words of each text row.
    """
    state = np.full(len(text), (1 << 64) - 1, np.uint64)
    flat, cells = masks.ravel(), np.ascontiguousarray(text.T, np.int64) + segment * masks.shape[1]
    for t in range(text.shape[1]):
        hit = flat.take(cells[t])
        if used is not None:
            hit[used <= t] = 0
        both = state & hit
        state = (state + both) | (state - both)
    whole = np.where(length >= 64, np.uint64((1 << 64) - 1), (np.uint64(1) << np.minimum(length, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & whole).astype(np.int64)


class WordBound:
    """Which runs of passages hold enough of a segment's words for a leak, by a count that is never too low.

    Of the ``m`` words of a segment ``need`` must be there, so of any ``k`` of them at least ``k - (m - need)``. For each segment
    the rarest ``k`` are counted whose bound stands farthest above what chance gives; the choice decides on time alone.
    """

    def __init__(self, counts: np.ndarray, times: np.ndarray, total: int) -> None:
        length = counts.sum(axis=1)
        least = np.ceil(length * LIKELY - 1e-9)
        self.short = length <= SHORT
        self.need = np.zeros(len(counts), np.uint8)
        self.table = np.zeros((counts.shape[1] + 1, len(counts)), np.uint8)
        chance = 1 - np.exp(-PASSAGE * times / max(1, total))
        for k in range(len(counts)):
            terms = np.flatnonzero(counts[k])
            terms = terms[np.argsort(chance[terms], kind="stable")]
            times_in = counts[k, terms]
            need = np.cumsum(times_in) - (length[k] - least[k])
            mean, spread = (np.cumsum(times_in**e * chance[terms]) * (2 if self.short[k] else WINDOW // PASSAGE) for e in (1, 2))
            best = int(np.argmax(np.where(need >= 1, (need - mean) / np.sqrt(spread + 0.1), -np.inf)))
            self.need[k] = need[best]
            self.table[terms[: best + 1], k] = times_in[: best + 1]
        self.used = self.table.any(axis=1)

    def candidates(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, segment) of the runs, as ``Confirm.around`` numbers windows."""
        at = np.flatnonzero(self.used[terms])
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = len(self.table)
        pair = np.unique(at // PASSAGE * size + terms[at])
        passage = pair // size
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        held = np.zeros((-(-len(terms) // PASSAGE), self.table.shape[1]), np.uint8)
        held[passage[first]] = np.add.reduceat(self.table[pair % size], first, axis=0, dtype=np.uint8)
        two = held.copy()
        two[:-1] += held[1:]
        four = np.minimum(two, 127)
        four[:-2] += four[2:].copy()
        run, segment = np.nonzero(np.where(self.short, two, four) >= self.need)
        return run + ~self.short[segment], segment


class Confirm:
    """Segments of a block as bit masks."""

    def __init__(self, block: list[Segment], vocabulary: np.ndarray) -> None:
        self.size = len(vocabulary)
        self.length = np.array([len(s.words) for s in block])
        self.answer = np.array([len(s.words) - s.answer for s in block])
        self.masks = np.zeros((len(block), self.size + 1), np.uint64)
        self.answers = np.zeros_like(self.masks)
        for k, s in enumerate(block):
            at = np.searchsorted(vocabulary, s.words)
            np.bitwise_or.at(self.masks[k], at, np.uint64(1) << np.arange(len(at), dtype=np.uint64))
            np.bitwise_or.at(self.answers[k], at[s.answer :], np.uint64(1) << np.arange(len(at) - s.answer, dtype=np.uint64))

    def around(self, terms: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The words of windows with a passage before and after."""
        padded = np.concatenate((np.full(PASSAGE, self.size), terms, np.full(4 * PASSAGE, self.size)))
        return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[window * PASSAGE].astype(np.int32)

    def best(self, text: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidate (window text, segment) pairs: which may be leaks, with the shares of words and answer in the best stretch
        that makes it a leak, 0 without one."""
        need = np.ceil(self.length * LIKELY - 1e-9).astype(np.int64)
        kept = np.flatnonzero(common_words(text, self.masks, segment, self.length[segment]) >= need[segment])
        text, segment = text[kept], segment[kept]
        m = self.length[segment]
        stretch, step = -(-3 * m // 2), np.maximum(1, m // 4)
        share, answer = np.zeros(len(kept)), np.zeros(len(kept))
        places = int((-(-(WINDOW - stretch) // step)).max()) + 1 if len(kept) else 0
        for k in range(places):
            offset = np.minimum(k * step, WINDOW - stretch)
            part = np.take_along_axis(text, np.minimum(offset[:, None] + np.arange(stretch.max()), WINDOW - 1), axis=1)
            common = common_words(part, self.masks, segment, m, stretch) / m
            rows = np.flatnonzero((common >= LIKELY) & (common >= share))
            if len(rows):
                asked, common = self.answer[segment[rows]], common[rows]
                there = common_words(part[rows], self.answers, segment[rows], asked, stretch[rows]) / asked
                better = ((common >= SURE) | (there >= ANSWER)) & ((common > share[rows]) | (there > answer[rows]))
                share[rows[better]], answer[rows[better]] = common[better], there[better]
        return kept, share, answer


def _search(encoded: DataFrame, block: list[Segment], vocabulary: np.ndarray, weights: np.ndarray, space: np.ndarray, items: np.ndarray,
            bound: WordBound) -> DataFrame:
    projected = _unit(items @ space).astype(np.float32).T
    table = np.vstack([space * weights[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
    of_item = np.array([s.item for s in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        confirm, weighted = Confirm(block, vocabulary), np.append(weights > 0, False)
        for batch in batches:
            out: list[tuple] = []
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def settle() -> None:
                row, text, segment = (np.concatenate(x) for x in zip(*held))
                kept, share, answer = confirm.best(text, segment)
                leak = (share >= SURE) | (share >= LIKELY) & (answer >= ANSWER)
                out.extend(zip(row[kept[leak]].tolist(), of_item[segment[kept[leak]]].tolist(), share[leak].tolist(), answer[leak].tolist()))
                held.clear()

            pairs = 0
            for row, terms in enumerate(_terms(batch.column(2))):
                sums = passage_sums(terms, table, weighted)
                windows = sums if len(sums) == 1 else sums[:-1] + sums[1:]
                found = (windows @ projected) >= COSINE * np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-6)
                either = [w * len(block) + k for w, k in (np.nonzero(found), bound.candidates(terms))]
                window, segment = np.divmod(np.unique(np.concatenate(either)), len(block))
                for at in range(0, len(window), PAIRS):
                    part = slice(at, at + PAIRS)
                    held.append((np.full(len(window[part]), row), confirm.around(terms, window[part]), segment[part]))
                    pairs += len(window[part])
                    if pairs >= PAIRS:
                        settle()
                        pairs = 0
            if held:
                settle()
            if out:
                rows, item, share, answer = zip(*out)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(item, pa.int32()), pa.array(share), pa.array(answer)],
                    ["doc_id", "text_key", "item", "common", "answer"])

    return encoded.mapInArrow(run, "doc_id long, text_key long, item int, common double, answer double")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, common, answer) of every document and item that it holds, the best stretch of each."""
    spark = docs.sparkSession
    count = benchmark.count()
    blocks = max(1, -(-count // (SEGMENTS // 2)) if count > SEGMENTS else 1)
    numbered = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn(
        "part", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(blocks))), "benchmark")
    schema = "doc_id long, text_key long, item_id long, common double, answer double"
    found = spark.createDataFrame([], schema)
    for part in range(blocks):
        rows = numbered.where(F.col("part") == part).select("item_id", "text").toArrow()
        if not rows.num_rows:
            continue
        every = segments(pa.chunked_array(rows.column("text")).combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        ids = rows.column("item_id").to_pylist()
        for at in range(0, len(every), SEGMENTS):
            found = found.unionByName(_block_leaks(docs, every[at : at + SEGMENTS], ids))
    best = found.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("common", "answer")).alias("best"))
    return best.select("doc_id", "text_key", "item_id", "best.common", "best.answer")


def _block_leaks(docs: DataFrame, block: list[Segment], ids: list) -> DataFrame:
    vocabulary = np.unique(np.concatenate([s.words for s in block]))
    encoded = stored(encode(docs, vocabulary), "terms")
    seen, times, rows, total = frequencies(encoded, len(vocabulary))
    counts = np.zeros((len(block), len(vocabulary)))
    for k, s in enumerate(block):
        np.add.at(counts[k], np.searchsorted(vocabulary, s.words), 1)
    rare = seen <= 0.1 * rows
    for k in range(len(block)):
        if not (counts[k] > 0)[rare].any():
            rare = rare | (counts[k] > 0)
    weights = np.log1p(rows / (1 + seen)) * rare
    items = _unit(counts * weights)
    space = latent_space(stored(passages(encoded, weights), "passages"), weights, items * ITEM_WEIGHT * max(1.0, total / ITEM_WORDS) ** 0.5)
    hits = stored(_search(encoded, block, vocabulary, weights, space, items, WordBound(counts, times, total)), "leaks")
    names = docs.sparkSession.createDataFrame([(s, ids[s]) for s in sorted({s.item for s in block})], "item int, item_id long")
    return hits.join(F.broadcast(names), "item").select("doc_id", "text_key", "item_id", "common", "answer")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    held = stored(leaks(docs, benchmark).select("doc_id", "text_key").distinct(), "leaking")
    return without(docs, held)
