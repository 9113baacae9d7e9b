"""Shards of nearly equal bytes by a histogram sort.

Rows are ordered by (64-bit hash of the text, doc_id), so equal texts stand next to each other and are cut only where
a group is too heavy for one shard. Splitters are found by counting: each round sums the exact bytes below candidate
boundaries over all partitions, and narrows the ranges that still hold a splitter, until every shard boundary is within
``tolerance`` of its ideal place. Only counts of candidates reach the driver, some thousands a round. A range that has
shrunk to one text is refined by doc_id. Then all rows are exchanged once, straight to the sorted pieces of the shards.

Size of a row: UTF-8 bytes of the text plus 8; a null text has 8. Edge cases: an empty table gives no rows. Null ids
come first. Rows that repeat both text and id share a key and are never cut apart. Other columns are carried along; input columns
named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import stored, text_key, text_or_empty

PROBE_BITS = 12
"""Each round cuts an open range into 2^12 candidates."""
LEAST = -(1 << 63)


def row_size(name: str = "text") -> Column:
    return F.octet_length(text_or_empty(name)).cast("long") + 8


def _refine(table: DataFrame, key: str, shift: int, open_at: dict, allowed: list[float]) -> tuple[dict, dict]:
    """Place targets among the values of ``key``. ``open_at``: (group, prefix) -> (bytes below, targets), a target a
    (number, place) pair. Gives number -> (group, boundary), and what stays open at single values of the key."""
    found: dict[int, tuple] = {}
    while open_at and shift > 0:
        step = min(PROBE_BITS, shift)
        here = F.shiftright(key, shift) if shift < 64 else F.lit(0).cast("long")
        probe = F.shiftright(key, shift - step).alias("probe")
        wanted = table.where(F.col("group").isin([g for g, _ in open_at]) & here.isin([p for _, p in open_at]))
        sums = wanted.groupBy("group", here.alias("here"), probe).agg(F.sum("size").alias("size")).collect()
        shift -= step
        inside = defaultdict(list)
        for r in sums:
            inside[r["group"], r["here"]].append((r["probe"], r["size"]))
        still = defaultdict(lambda: (0, []))
        for at, (below, targets) in open_at.items():
            candidates = sorted(inside[at])
            i = 0
            for number, place in sorted(targets, key=lambda t: t[1]):
                while i < len(candidates) - 1 and below + candidates[i][1] < place:
                    below, i = below + candidates[i][1], i + 1
                probe_at, size = candidates[i]
                edge, miss = min(((probe_at, abs(place - below)), (probe_at + 1, abs(below + size - place))), key=lambda x: x[1])
                if miss <= allowed[number]:
                    found[number] = (at[0], edge << shift if edge << shift < 1 << 63 else None)
                else:
                    still[at[0], probe_at] = (below, [*still[at[0], probe_at][1], (number, place)])
        open_at = dict(still)
    return found, open_at


def splitters(keys: DataFrame, places: list[float], allowed: list[float]) -> list[tuple[int, int]]:
    """Boundaries (hash, id) so that the bytes of smaller keys are ``places``, each up to what is allowed.
    ``keys``: hash, id, size."""
    whole = keys.select(F.lit(0).cast("long").alias("group"), "hash", "size")
    found, rest = _refine(whole, "hash", 64, {(0, 0): (0, list(enumerate(places)))}, allowed)
    end = (1 << 63) - 1
    cuts = {n: (end, end) if edge is None else (edge, LEAST) for n, (_, edge) in found.items()}
    if rest:
        hot = keys.where(F.col("hash").isin([p for _, p in rest])).withColumnRenamed("hash", "group")
        spans = {r["group"]: r for r in hot.groupBy("group").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()}
        for group, r in spans.items():
            shift = (r["high"] - r["low"]).bit_length()
            if shift > 63:  # ids of both signs over all 64 bits: order them by the bits themselves
                ids, shift, low = F.col("id"), 64, 0
            else:
                ids, low = F.col("id") - F.lit(r["low"]), r["low"]
            below, targets = rest[0, group]
            inner = hot.where(F.col("group") == group).select("group", ids.alias("at"), "size")
            placed, last = _refine(inner, "at", shift, {(group, 0): (below, targets)}, allowed)
            cuts |= {n: (group, end if at is None else min(at + low, end)) for n, (_, at) in placed.items()}
            for (_, at), (under, open_) in last.items():
                cuts |= {n: (group, at + low) for n, _ in open_}
            if not shift:
                cuts |= {n: (group, LEAST) for n, _ in targets}
    ordered = [cuts[n] for n in range(len(places))]
    return [max(ordered[: i + 1]) for i in range(len(ordered))]


def _position(cuts: list[tuple[int, int]], lo: int, hi: int) -> Column:
    """Number of cuts at or below the row's key, by a binary search written as nested conditions."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    cut_hash, cut_id = cuts[mid]
    above = (F.col("__hash") > cut_hash) | ((F.col("__hash") == cut_hash) & (F.col("__id") >= cut_id))
    return F.when(above, _position(cuts, mid + 1, hi)).otherwise(_position(cuts, lo, mid))


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.005, piece_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, its place in the shard from 0 on, sorted by shard and slot.

    A shard differs from its equal share by at most twice ``tolerance`` of the share and the weight of one key.
    ``piece_bytes``: a task sorts about so many bytes; a shard is as many pieces as that takes. The driver holds a
    few counts for each piece.
    """
    order = [text_key().alias("hash"), F.coalesce("doc_id", F.lit(LEAST)).alias("id")]
    keys = stored(docs.select(*order, row_size().alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * piece_bytes)))
    pieces = shards * per_shard
    places = [total * k / pieces for k in range(1, pieces)]
    allowed = [total / shards * tolerance if k % per_shard == 0 else total / pieces / 4 for k in range(1, pieces)]
    cuts = splitters(keys, places, allowed) if total else [((1 << 63) - 1,) * 2] * (pieces - 1)
    piece = _position(cuts, 0, len(cuts))
    counted = keys.select(F.col("hash").alias("__hash"), F.col("id").alias("__id")).groupBy(piece.alias("piece")).count()
    rows = {r["piece"]: r["count"] for r in counted.collect()}
    begins, first = [], 0
    for k in range(pieces):
        first = 0 if k % per_shard == 0 else first + rows.get(k - 1, 0)
        begins.append(first)
    keyed = docs.select("*", order[0].alias("__hash"), order[1].alias("__id"))
    dealt = keyed.withColumn("__piece", piece).repartitionById(pieces, "__piece").sortWithinPartitions("__hash", "__id")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    begin = F.element_at(F.array(*[F.lit(b).cast("long") for b in begins]), F.col("__piece") + 1)
    return dealt.select(
        *[dealt[f"`{c}`"] for c in docs.columns if c not in ("shard", "slot")],
        (F.col("__piece") / per_shard).cast("int").alias("shard"), (begin + place).alias("slot"),
    )
