"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the longest sequence is cut into pieces; nothing is dropped. Pieces are dealt to groups of
about ``GROUP`` by a hash, and each task packs its groups best-fit decreasing over bins of all permitted lengths at
once: a piece goes to the open bin, of whatever length, that it leaves the least room in. If none has room, the
length with the least cost is opened, where cost = length + ``overhead`` - reuse * (room left), and ``reuse`` is the share of the room
that later pieces are expected to fill. Each group is packed for several values of ``reuse``, every bin is then
shrunk to the shortest permitted length that holds its contents, and the cheapest outcome stays.

Edge cases: an empty table gives no pieces; an empty or null text takes its end mark only; equal lengths and repeated
rows are told apart by a stored row number; columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import stored, text_or_empty

LENGTHS = (512, 1024, 2048, 4096)
GROUP = 20_000
REUSE = (0.0, 0.5, 0.8, 0.9, 0.95, 1.0)
OVERHEAD = 16


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def best_fit(sizes: Sequence[int], lengths: Sequence[int], reuse: float, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and position of each piece, and the final length of each bin. ``sizes`` must descend."""
    rooms: list[tuple[int, int]] = []
    used: list[int] = []
    bins, positions = [], []
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            length = min((c for c in lengths if c >= size), key=lambda c: (c + overhead - reuse * (c - size), -c))
            room, number = length, len(used)
            used.append(0)
        bins.append(number)
        positions.append(used[number])
        used[number] += size
        if room > size:
            insort(rooms, (room - size, number))
    return bins, positions, [min(c for c in lengths if c >= u) for u in used]


def cheapest(sizes: Sequence[int], lengths: Sequence[int], overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """The packing with the least sum of bin lengths and overheads over all values of ``reuse``."""
    every = (best_fit(sizes, lengths, r, overhead) for r in REUSE)
    return min(every, key=lambda p: sum(p[2]) + overhead * len(p[2]))


def pieces(docs: DataFrame, longest: int, size: Column) -> DataFrame:
    """(doc_id, piece, start, length, row): a document's words and an end mark, cut at the longest length."""
    sized = docs.select("doc_id", (size + 1).alias("size"))
    sized = stored(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    last = F.floor((F.col("size") - 1) / longest).cast("long")
    cut = sized.select("doc_id", "size", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).alias("length"), "row")


PLACED = "doc_id long, piece long, start long, length long, bin long, position long, bin_length long, bin_used long"


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, size: Column | None = None) -> DataFrame:
    """The place of every piece: its bin, its position there, and the bin's length and filling."""
    lengths = sorted(lengths)
    cut = pieces(docs, lengths[-1], word_count() if size is None else size)
    groups = max(1, -(-cut.count() // GROUP))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        sizes = table.column("length").to_pylist()
        bins, positions, finals = cheapest(sizes, lengths, overhead)
        used = [0] * len(finals)
        for b, s in zip(bins, sizes):
            used[b] += s
        base = keys[0].as_py() << 32
        table = table.select(["doc_id", "piece", "start", "length"])
        for name, values in (("bin", [base + b for b in bins]), ("position", positions),
                             ("bin_length", [finals[b] for b in bins]), ("bin_used", [used[b] for b in bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("group").applyInArrow(run, PLACED)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per bin with its pieces in order; a bin's length bounds their number."""
    part = F.struct("position", "doc_id", "start", "length")
    return placed.groupBy("bin", "bin_length", "bin_used").agg(F.sort_array(F.collect_list(part)).alias("parts"))
