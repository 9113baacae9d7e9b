"""Removal of repeated byte strings by a sampled, range-partitioned suffix sort.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes; matches never cross texts, and
strings are judged on the input.

1. Suffixes are sampled where a string of ``LENGTH`` bytes must have one: its least ``LEAD``-byte word by hash, the leftmost of
   equals. Equal strings so have their sampled suffix in the same place. All neighbouring strings with one such suffix make
   a record, about one for every 90 bytes: the leading bytes and hash of the suffix, and a hash of the stretch that the strings cover.
2. Splitters from a sample range-partition the records by the suffixes' leading bytes, then by hash, stretch and place (of id
   and row), so that also a word, stretch or whole text that a third of all rows share is cut into buckets of even size.
3. Buckets are sorted by multikey quicksort: by the first key, then ties only by the next. Neighbours tell which stretches
   occur twice (all their strings are repeated) and which suffixes begin several stretches. The first and last record
   of every bucket are compared across the boundary.
4. Stretches that share their suffix only are compared string by string: their bytes meet by suffix, and a multikey
   quicksort over words of eight bytes leaves the strings that are equal throughout. Suffixes of more than ``CROWD`` different
   stretches are cut into single strings instead, which are counted by 128 bits, so no group must fit in a task.

Edge cases: a null text is empty; texts under ``LENGTH`` bytes keep all; rows that repeat id and text are two places, so their
strings are repeated; null ids are returned as null; an empty table gives no rows; other columns are not read. Very
long texts are worked on in pieces that overlap by ``LENGTH - 1`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import stored, text_key, text_or_empty
from tabsmith.llm.words import BYTE_CODES, mix, powers, prefix_hashes, span_hashes, text_buffers

LENGTH = 200
LEAD = 24
PIECE = 1 << 19
BUCKET_BYTES = 32 << 20
SAMPLE_BYTES = 16 << 20
CROWD = 20_000
PLACE = "doc_id long, text_key long, start long, end long, at int, lead long, word long, stretch long"
PLACE_NAMES = ["doc_id", "text_key", "start", "end", "at", "lead", "word", "stretch"]


def pieces(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of stretches (text, from, to) of about ``PIECE`` bytes; together they hold every string of ``LENGTH`` bytes once."""
    out: list[tuple[int, int, int]] = []
    size = 0
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for at in range(lo, hi - LENGTH + 1, PIECE):
            out.append((i, at, min(hi, at + PIECE + LENGTH - 1)))
            size += out[-1][2] - at
            if size >= PIECE:
                yield tuple(np.array(x) for x in zip(*out))
                out, size = [], 0
    if out:
        yield tuple(np.array(x) for x in zip(*out))


def least_words(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash (its upper bits), leftmost of equals, in each window of ``width``."""
    bits = max(1, int(len(hashes)).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    return (least & low).astype(np.int64)


def records(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, end, place of the suffix, its leading bytes, its word, the stretch) of all records, piece by piece.

    Hashes of a piece do not depend on what else is in it, as the order of words takes only their upper 40 bits.
    """
    for text, lo, hi in pieces(offsets):
        size = hi - lo
        begin = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(lo - begin[:-1], size) + np.arange(begin[-1])
        buffer = data[where]
        prefix = prefix_hashes(BYTE_CODES[buffer])
        n = len(buffer)
        inverse = powers(n + 1)[1]
        words = mix((prefix[LEAD:] - prefix[: n - LEAD + 1]) * inverse[: n - LEAD + 1])
        coarse = words & np.uint64((1 << 64) - (1 << 24))
        least = least_words(coarse, LENGTH - LEAD + 1)
        of = np.repeat(np.arange(len(text)), size)[: len(least)]
        fits = np.arange(len(least)) + LENGTH <= begin[1:][of]
        strings = np.flatnonzero(fits)
        anchor, owner = least[strings], of[strings]
        new = np.ones(len(strings), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(strings)) - 1
        start, end, anchor, owner = strings[first], strings[last] + LENGTH, anchor[first], owner[first]
        eight = np.lib.stride_tricks.sliding_window_view(buffer, 8)[anchor]
        lead = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)
        shift = lo[owner] - begin[:-1][owner] - offsets[text[owner]]
        yield text[owner], start + shift, end + shift, anchor - start, lead, words[anchor], mix(span_hashes(prefix, start, end) + (end - start).astype(np.uint64))


def sort_key(lead: np.ndarray, word: np.ndarray, stretch: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """32 bytes that order records: by leading bytes, word, stretch, and a spread of the place."""
    place = mix(row ^ mix(start.astype(np.uint64), 2), 9)
    return np.ascontiguousarray(np.stack([lead, word, stretch, place], axis=1).astype(">u8")).view("S32").ravel()


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; only runs of ties are sorted further, by the next key."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.zeros(len(order), np.int64)
    tied[1:] = np.cumsum(keys[0][order][1:] != keys[0][order][:-1])
    for key in keys[1:]:
        size = np.bincount(tied, minlength=int(tied[-1]) + 1 if len(tied) else 0)
        open_ = np.flatnonzero(size[tied] > 1)
        if not len(open_):
            break
        rows = order[open_]
        turn = np.lexsort((key[rows], tied[open_]))
        order[open_] = rows[turn]
        change = np.zeros(len(order), bool)
        change[1:] = tied[1:] != tied[:-1]
        inner = np.zeros(len(order), bool)
        inner[open_[1:]] = key[order[open_[1:]]] != key[order[open_[:-1]]]
        tied = np.cumsum(change | inner)
    return order


def equal_strings(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the strings data[at : at + LENGTH] occur twice in their group: multikey quicksort by words of eight bytes."""
    rows = np.arange(len(at))
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    for skip in range(0, LENGTH, 8):
        if not len(rows):
            break
        word = np.ascontiguousarray(view[at[rows] + min(skip, LENGTH - 8)]).view("<u8").ravel()
        order = np.lexsort((word, group[rows]))
        rows, word = rows[order], word[order]
        new = np.ones(len(rows), bool)
        new[1:] = (group[rows][1:] != group[rows][:-1]) | (word[1:] != word[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        group = group.copy() if skip == 0 else group
        group[rows] = number
        rows = rows[many]
    out = np.zeros(len(at), bool)
    out[rows] = True
    return out


def _place_batch(ids: pa.RecordBatch, part: tuple[np.ndarray, ...], buckets: np.ndarray | None) -> pa.RecordBatch:
    text, start, end, at, lead, word, stretch = part
    take = pa.array(text)
    columns = [ids.column(0).take(take), ids.column(1).take(take), pa.array(start), pa.array(end), pa.array(at.astype(np.int32)),
               *[pa.array(x.view(np.int64)) for x in (lead, word, stretch)]]
    names = list(PLACE_NAMES)
    if buckets is None:
        columns.append(ids.column(3).take(take))
        names.append("row")
    else:
        key = sort_key(lead, word, stretch, ids.column(3).to_numpy().view(np.uint64)[text], start)
        columns.append(pa.array(np.searchsorted(buckets, key, "right").astype(np.int32)))
        names.append("bucket")
    return pa.RecordBatch.from_arrays(columns, names)


def row_hash() -> Column:
    """Parts rows that repeat a text, or text and id. It only decides on buckets and samples, never on the result."""
    return F.xxhash64("doc_id", text_key(), F.monotonically_increasing_id())


def places(docs: DataFrame, splitters: np.ndarray | None) -> DataFrame:
    """The records of all texts, with their bucket if there are splitters, else with a hash of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for part in records(data, offsets):
                yield _place_batch(batch, part, splitters)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text", row_hash().alias("row"))
    return rows.mapInArrow(run, PLACE + (", row long" if splitters is None else ", bucket int"))


def sampled_splitters(docs: DataFrame, total: int) -> np.ndarray:
    """Keys that cut the records into buckets of about ``BUCKET_BYTES`` of text, from some ``SAMPLE_BYTES`` of it."""
    count = -(-total // BUCKET_BYTES)
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    # a sample of whole texts would miss what long ones hold, so texts are drawn by hash and records thinned by count
    drawn = docs.where(F.pmod(row_hash(), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = places(drawn, None).select("lead", "word", "stretch", "row", "start")
    rows = rows.where(F.pmod(F.xxhash64("row", "start"), F.lit(max(1, int(min(total, SAMPLE_BYTES) / 90 / (200 * max(1, count)))))) == 0)
    table = rows.toArrow()  # some 200 keys a bucket
    if not table.num_rows or count < 2:
        return np.zeros(0, "S32")
    c = [table.column(n).to_numpy() for n in ("lead", "word", "stretch", "row", "start")]
    keys = np.sort(sort_key(*[x.view(np.uint64) for x in c[:4]], c[4]))
    return keys[np.arange(1, count) * len(keys) // count]


FOUND = PLACE + ", bucket int, kind string"


def sorted_buckets(dealt: DataFrame, buckets: int) -> DataFrame:
    """Sort each bucket; what neighbours tell: ``twice`` (the stretch is repeated), ``shared`` (one row per different stretch
    of a suffix that begins several), and ``first`` and ``last`` of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lead, word, stretch = (table.column(n).to_numpy().view(np.uint64) for n in ("lead", "word", "stretch"))
        order = multikey_order([lead, word, stretch])
        lead, word, stretch = lead[order], word[order], stretch[order]
        suffix = np.ones(len(order), bool)
        suffix[1:] = (lead[1:] != lead[:-1]) | (word[1:] != word[:-1])
        each = suffix.copy()
        each[1:] |= stretch[1:] != stretch[:-1]
        of_suffix, of_stretch = np.cumsum(suffix) - 1, np.cumsum(each) - 1
        twice = np.bincount(of_stretch)[of_stretch] > 1
        several = np.bincount(of_suffix, weights=each)[of_suffix] > 1
        for kind, rows in (("twice", np.flatnonzero(twice)), ("shared", np.flatnonzero(each & several)),
                           ("first", np.array([0])), ("last", np.array([len(order) - 1]))):
            for at in range(0, len(rows), 50_000):
                part = table.take(pa.array(order[rows[at : at + 50_000]]))
                yield from part.append_column("kind", pa.array([kind] * part.num_rows)).to_batches()

    return dealt.repartitionById(buckets, "bucket").mapInArrow(run, FOUND)


def across_boundaries(found: DataFrame) -> DataFrame:
    """More ``twice`` and ``shared`` rows: the last record of a bucket against the first of the next that has any."""
    edges = found.where(F.col("kind").isin("first", "last")).collect()  # two rows a bucket
    ends = {(r["bucket"], r["kind"]): r for r in edges}
    full = sorted({b for b, _ in ends})
    rows = []
    for a, b in zip(full, full[1:]):
        x, y = ends[a, "last"], ends[b, "first"]
        if (x["lead"], x["word"]) == (y["lead"], y["word"]):
            kind = "twice" if x["stretch"] == y["stretch"] else "shared"
            rows += [{**x.asDict(), "kind": kind}, {**y.asDict(), "kind": kind}]
    return found.sparkSession.createDataFrame([tuple(r[n] for n in [*PLACE_NAMES, "bucket", "kind"]) for r in rows], FOUND)


def _joined(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts next to the lists of their places; rows that repeat id and text have the same list."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_or_empty().alias("text"))
    side = lists.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "list")
    return keyed.join(side.hint("merge"), (keyed["text_key"] == side["__key"]) & keyed["doc_id"].eqNullSafe(side["__id"]), how)


def repeated_strings(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end) of the repeated strings among stretches that share their suffix only."""
    crowds = shared.groupBy("word").agg(F.count("*").alias("members")).withColumn("crowd", F.col("members") > CROWD)
    shared = shared.join(crowds.select("word", "crowd"), "word")
    part = F.struct("start", "end", "at", "word", "crowd")
    lists = shared.groupBy("doc_id", "text_key").agg(F.collect_set(part).alias("list"))  # bounded by the text
    once = _joined(docs, lists, "inner")  # a row that repeats id and text is cut twice: its strings are repeated indeed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py().encode()
                parts = batch.column(3)[row].as_py()
                for i in range(0, len(parts), 2000):
                    some = parts[i : i + 2000]
                    ids = [pa.array([batch.column(c)[row].as_py()] * len(some), pa.int64()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*ids, pa.array([p["start"] for p in some], pa.int64()), pa.array([p["at"] for p in some], pa.int32()),
                         pa.array([p["word"] for p in some], pa.int64()), pa.array([p["crowd"] for p in some]),
                         pa.array([text[p["start"] : p["end"]] for p in some], pa.binary())],
                        ["doc_id", "text_key", "start", "at", "word", "crowd", "bytes"])

    bytes_of = stored(once.select("doc_id", "text_key", "text", "list").mapInArrow(
        cut, "doc_id long, text_key long, start long, at int, word long, crowd boolean, bytes binary"), "stretches")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by word: whole words are compared together, some megabytes at a time
            for at, run in _runs(batch.column(3).to_numpy()):
                if group and size > PIECE * 4 and group[-1].column(3)[-1].as_py() != run:
                    yield _equal(group)
                    group, size = [], 0
                stop = at[1] - at[0]
                group.append(batch.slice(at[0], stop))
                size += stop * (LENGTH + 90)
        if group:
            yield _equal(group)

    quiet = bytes_of.where(~F.col("crowd")).select("doc_id", "text_key", "start", "word", "bytes")
    local = quiet.repartition("word").sortWithinPartitions("word").mapInArrow(compare, "doc_id long, text_key long, start long, end long")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                stretch = batch.column(3)[row].as_py()
                starts = list(range(len(stretch) - LENGTH + 1))
                ids = [pa.array([batch.column(c)[row].as_py()] * len(starts), pa.int64()) for c in (0, 1)]
                first = batch.column(2)[row].as_py()
                digests = [hashlib.blake2b(stretch[s : s + LENGTH], digest_size=16).digest() for s in starts]
                yield pa.RecordBatch.from_arrays([*ids, pa.array([first + s for s in starts], pa.int64()), pa.array(digests, pa.binary())],
                                                 ["doc_id", "text_key", "start", "string"])

    crowded = bytes_of.where("crowd").select("doc_id", "text_key", "start", "bytes").mapInArrow(
        single, "doc_id long, text_key long, start long, string binary")
    again = crowded.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
    wide = crowded.join(again, "string").select("doc_id", "text_key", "start", (F.col("start") + LENGTH).alias("end"))
    return local.unionByName(wide)


def _runs(values: np.ndarray) -> Iterator[tuple[tuple[int, int], int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        if hi > lo:
            yield (lo, hi), int(values[lo])


def _equal(group: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Runs of repeated strings of stretches, compared within their word."""
    table = pa.Table.from_batches(group).combine_chunks()
    column = table.column("bytes").combine_chunks().cast(pa.large_binary())
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.concatenate((np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)))
    begin = offsets[:-1] - offsets[0]
    count = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    _, word = np.unique(table.column("word").to_numpy(), return_inverse=True)
    hit = np.flatnonzero(equal_strings(data, begin[row] + inner, word[row].astype(np.int64)))
    row, inner = row[hit], inner[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    row, start, end = row[first], inner[first], inner[last[: len(first)]] + LENGTH
    base = table.column("start").to_numpy()[row]
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [table.column("doc_id").combine_chunks().take(take), table.column("text_key").combine_chunks().take(take),
         pa.array(base + start), pa.array(base + end)], ["doc_id", "text_key", "start", "end"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end): byte ranges, overlapping each other, that together are what to remove."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty()).cast("long"))).first()[0] or 0
    splitters = sampled_splitters(docs, total)
    found = stored(sorted_buckets(places(docs, splitters), len(splitters) + 1), "suffixes")
    found = found.where(~F.col("kind").isin("first", "last")).unionByName(across_boundaries(found))
    some = repeated_strings(docs, found.where("kind = 'shared'").select(*PLACE_NAMES).distinct())
    whole = found.where("kind = 'twice'").select("doc_id", "text_key", "start", "end")
    return stored(whole.unionByName(some).distinct(), "repeated")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` holds the bytes that stay."""
    spans = repeated_spans(docs).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("list"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text, ranges in zip(part.column(1), part.column(2).to_pylist()):
                    data = text.as_py().encode()
                    kept, done, removed, runs = [], 0, 0, 0
                    for r in ranges or ():
                        if r["start"] > done or not runs:
                            kept.append(data[done : r["start"]])
                            runs, done = runs + 1, r["start"]
                        removed += max(0, r["end"] - done)
                        done = max(done, r["end"])
                    kept.append(data[done:])
                    rows.append((len(data), removed, runs, b"".join(kept)))
                n, removed, runs, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _joined(docs, spans, "left").select("doc_id", "text", "list").mapInArrow(run, schema)
