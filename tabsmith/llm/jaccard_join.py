"""Similarity join of documents on word n-grams, by rare-first prefix filtering.

A document's set is its distinct shingles of ``size`` words (64-bit hashes; words are runs without ASCII white space,
A-Z read as a-z); with fewer words it is the whole sequence as one shingle. Two sets are linked when
100 * |both| >= ``percent`` * |either|.

1. Equal sets are one node, named by 128 bits of the set, so copies cost nothing further. A sketch of fixed size counts all
   shingles; the order (count, hash) puts rare ones first.
2. Sets that are linked share one of their first n - ceil(percent * n) + 1 shingles. Only shared shingles are kept.
3. A first join compares each node with two heads of each shingle's group. Verified links make components. In the rounds that follow each node tries the
   likeliest of its pairs with heads of other components, drawn anew for each shingle and round, until such pairs join little more. So a large group of near
   copies becomes one component for a few pairs a member.
4. The join proper pairs nodes of components that are still apart on their first common prefix shingle, if length, position
   and suffix allow a link. The suffix filter bounds the symmetric difference by 512 parity bits of each set.
5. Pairs are verified on the whole sets, once each; a pair that other links have joined by then is passed over. Components of
   all links are found by alternating stars.

A very long text is one row of every table; a row remembers at most ``EARLIER`` shingles for each of its prefix's, and a pair that meets again beyond them is made
one. Edge cases: null or empty texts have no set, and link with nothing; null ids are never the smallest unless a component has no
other; rows that repeat id and text share a component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import bounded, stored, text_key, without
from tabsmith.llm.components import components
from tabsmith.llm.words import Words, distinct, mix, shingles, words
from tabsmith.operators.lookup import attach

COUNTER_BITS = 20
SLOTS = 64
SKETCH = [f"p{i}" for i in range(8)]
"""Columns of 64 parity bits each."""
HEADS = 8
"""Members of a shingle's group that all others are compared with in a round."""
ROUNDS, YIELD = 10, 0.01
"""Rounds of stars end when they find fewer links than this share of the nodes whose shingles are still shared by several components, or after so many."""
EARLIER = 64
"""Tokens of a node that a row remembers to tell pairs that met before."""
VERIFIED_AT_ONCE = 128
EARLY_TURNS = 2
"""Turns in which only one pair of each node is verified."""


def _sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs of a slice, and where each text begins."""
    text, value = distinct(*shingles(w, size), w.texts)
    return text, value, np.searchsorted(text, np.arange(w.texts + 1))


def _names(value: np.ndarray, begin: np.ndarray) -> list[bytes | None]:
    """128 bits of each text's set; None for an empty one."""
    out: list[bytes | None] = [None] * (len(begin) - 1)
    full = np.flatnonzero(begin[1:] > begin[:-1])
    if len(full):
        sums = np.stack([np.add.reduceat(mix(value, s), begin[full]) for s in (3, 5)], axis=1)
        for i, name in zip(full.tolist(), sums):
            out[i] = name.tobytes()
    return out


def _parity(text: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    size = 64 * len(SKETCH)
    counts = np.bincount(text * size + (value % np.uint64(size)).astype(np.int64), minlength=texts * size)
    bits = np.packbits((counts & 1).astype(np.uint8).reshape(texts, size), axis=1)
    return np.ascontiguousarray(bits).view(np.int64)


def _summaries(docs: DataFrame, size: int) -> DataFrame:
    """A row per document, and rows with counters of all shingles (``slot`` is set)."""
    fields = "doc_id long, text_key long, n long, name binary, " + ", ".join(f"{p} long" for p in SKETCH) + ", slot int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for w in words(batch.column(2)):
                text, value, begin = _sets(w, size)
                np.add.at(counters, (value >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))
                parity = _parity(text, value, w.texts)
                rows = slice(w.first, w.first + w.texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(np.diff(begin)), pa.array(_names(value, begin), pa.binary()),
                     *[pa.array(parity[:, i].copy()) for i in range(len(SKETCH))], pa.nulls(w.texts, pa.int32()), pa.nulls(w.texts, pa.binary())],
                    ["doc_id", "text_key", "n", "name", *SKETCH, "slot", "counts"])
        parts = counters.reshape(SLOTS, -1)
        some = [i for i in range(SLOTS) if parts[i].any()]
        empty = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [empty, empty, empty, pa.nulls(len(some), pa.binary()), *[empty] * len(SKETCH), pa.array(some, pa.int32()),
             pa.array([parts[i].tobytes() for i in some], pa.binary())],
            ["doc_id", "text_key", "n", "name", *SKETCH, "slot", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(run, fields)


def _counters(summaries: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters: 2^20 numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_py(), np.uint32)
                sums[slot] = sums[slot] + part if slot in sums else part.astype(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slot", "counts"])

    rows = summaries.where("slot is not null").select("slot", "counts").repartition(8, "slot").mapInArrow(add, "slot int, counts binary").collect()
    out = np.zeros((SLOTS, (1 << COUNTER_BITS) // SLOTS), np.uint64)
    for r in rows:
        out[r["slot"]] = np.frombuffer(r["counts"], np.uint64)
    return np.minimum(out.reshape(-1), (1 << 44) - 1)


def _prefixes(docs: DataFrame, size: int, percent: int, counters: np.ndarray) -> DataFrame:
    """(name, n, tokens): the first shingles of each set, rare ones first; a row per document, less what a task repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for w in words(batch.column(0)):
                text, value, begin = _sets(w, size)
                names, out = _names(value, begin), []
                rarity = counters[(value >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                for i, name in enumerate(names):
                    if name is None or name in seen:
                        continue
                    seen.add(name)
                    lo, hi = begin[i], begin[i + 1]
                    n = int(hi - lo)
                    first = np.argsort(rarity[lo:hi], kind="stable")[: n - -(-percent * n // 100) + 1]  # values ascend: ties by hash
                    out.append((name, n, value[lo:hi][first].view(np.int64)))
                if out:
                    tokens = pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum([len(t) for _, _, t in out]))).astype(np.int32)), pa.array(np.concatenate([t for *_, t in out])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), tokens], ["name", "n", "tokens"])

    return docs.select("text").mapInArrow(run, "name binary, n long, tokens array<long>")


def _may_link(percent: int) -> tuple[Column, Column, Column]:
    """Length and position filter, suffix filter, and what the suffix filter leaves to spare, of rows ``a`` and ``b`` that meet in a token."""
    n, m = F.col("a.n"), F.col("b.n")
    need = F.ceil(percent * (n + m) / (100 + percent) - 1e-9)
    place = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - F.col("a.pos"), m - F.col("b.pos")) >= need)
    apart = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in SKETCH), F.lit(0))
    spare = n + m - 2 * need - apart
    return place, spare >= 0, spare


def _texts(ids: DataFrame, docs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(id, text) of one document of each node in ``ids``."""
    wanted = stored(nodes.select("id", "first").join(ids, "id").select("id", "first.doc_id", "first.text_key"), f"{name}-ids")
    side = wanted.select("id", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    side = F.broadcast(side) if bounded(wanted) else side.hint("merge")
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    keyed = keyed.join(side, keyed["doc_id"].eqNullSafe(side["__id"]) & (keyed["text_key"] == side["__key"]))
    return stored(keyed.select("id", "text"), name)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough. Texts meet in a task, being shorter than their sets."""
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VERIFIED_AT_ONCE):
                part = batch.slice(at, VERIFIED_AT_ONCE)
                sets: list[np.ndarray] = []
                for w in words(pa.concat_arrays([part.column(2), part.column(3)])):
                    _, value, begin = _sets(w, size)
                    sets += [value[lo:hi] for lo, hi in zip(begin, begin[1:])]
                n = part.num_rows
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets[:n], sets[n:])]
                kept = pa.array([100 * k >= percent * (len(x) + len(y) - k) for k, x, y in zip(common, sets[:n], sets[n:])])
                yield part.select(["u", "v"]).filter(kept)

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _merged(part: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components (node, root) after more links. Only the components that the links touch take part, as one node each."""
    edges = links
    for side in ("u", "v"):
        of = part.select(F.col("node").alias(side), F.col("root").alias("__root"))
        edges = edges.join(of, side, "left").withColumn(side, F.coalesce("__root", side)).drop("__root")
    joined = stored(components(edges.where("u <> v").distinct()), f"{name}-joined")
    moved = part.join(joined.select(F.col("node").alias("root"), F.col("root").alias("__new")), "root", "left")
    moved = moved.select("node", F.coalesce("__new", "root").alias("root"))
    return stored(moved.unionByName(joined.join(part.select("node"), "node", "left_anti").select("node", "root")), name)


def _mixed(slim: DataFrame, part: DataFrame) -> DataFrame:
    """The rows of ``slim`` whose token is shared by several components, with their component as ``part``."""
    named = slim.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("root", "id")).drop("root")
    mixed = named.groupBy("token").agg(F.min("part").alias("one"), F.max("part").alias("other")).where("one <> other").select("token")
    return named.join(mixed, "token")


def _star_round(mixed: DataFrame, traits: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each node the likeliest of its pairs (u, v) with heads of its tokens, which are drawn anew per token and turn."""
    place, suffix, spare = _may_link(percent)
    rows = mixed.join(traits, "id")
    order = F.xxhash64("id", "token", F.lit(turn))
    head = F.struct(order.alias("order"), "id", "n", "pos", "part", *SKETCH)
    heads = rows.groupBy("token", F.pmod(order, F.lit(HEADS)).alias("lot")).agg(F.min(head).alias("head")).select("token", "head.*").drop("order")
    pair = (F.col("a.token") == F.col("b.token")) & (F.col("a.part") != F.col("b.part"))
    near = rows.alias("a").join(heads.alias("b"), pair & place & suffix)
    best = near.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), spare.alias("spare")).groupBy("u").agg(F.max_by("v", "spare").alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _joined(pairs: DataFrame, part: DataFrame, verified) -> DataFrame:
    """Components after all links among ``pairs``. One pair of each node is verified first, then again; pairs that have
    come to lie inside a component by then can change nothing, and only the others are verified."""
    for turn in range(EARLY_TURNS):
        mark = F.xxhash64("u", "v", F.lit(turn))
        one = pairs.groupBy("u").agg(F.min_by("v", mark).alias("v"))
        other = pairs.groupBy("v").agg(F.min_by("u", mark).alias("u"))
        some = stored(one.unionByName(other).distinct(), "picked-pairs")
        part = _merged(part, stored(verified(some), "picked-links"), "part")
        left = pairs.join(some, ["u", "v"], "left_anti")
        for side in ("u", "v"):
            left = left.join(part.select(F.col("node").alias(side), F.col("root").alias(f"of_{side}")), side, "left")
        apart = F.coalesce("of_u", "u") != F.coalesce("of_v", "v")
        pairs = stored(left.where(apart).select("u", "v"), "pairs-left")
    return _merged(part, stored(verified(pairs), "last-links"), "components")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, text_key, n_shingles, component_id, and ``first``: whether the component is named by this row."""
    every = stored(_summaries(docs, size), "summaries")
    summaries = every.where("slot is null").drop("slot", "counts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    firsts = summaries.where("name is not null").groupBy("name").agg(F.min(order).alias("first"), *[F.first(p).alias(p) for p in SKETCH])
    prefixes = _prefixes(docs, size, percent, _counters(every)).groupBy("name").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    nodes = stored(firsts.join(prefixes, "name").withColumn("id", F.monotonically_increasing_id()), "nodes")

    exploded = nodes.select("id", F.posexplode("tokens").alias("pos", "token"))
    shared = exploded.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    slim = stored(exploded.join(shared, "token").join(nodes.select("id", "n"), "id"), "candidates")
    place, suffix, _ = _may_link(percent)
    head = F.struct(F.xxhash64("id").alias("order"), "id", "n", "pos")
    heads = slim.groupBy("token").agg(F.min(head).alias("low"), F.max(head).alias("high"))
    heads = heads.select("token", F.explode(F.array("low", "high")).alias("head")).select("token", "head.*").drop("order")
    near = slim.alias("a").join(heads.alias("b"), F.col("a.token") == F.col("b.token")).where((F.col("a.id") != F.col("b.id")) & place)
    stars = stored(near.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct(), "stars")
    traits = nodes.select("id", *SKETCH)
    sized = nodes.select("id", "n", F.lit(0).alias("pos"), *SKETCH)
    likely = stars.join(sized.alias("a"), F.col("u") == F.col("a.id")).join(sized.alias("b"), F.col("v") == F.col("b.id")).where(suffix)
    likely = stored(likely.select("u", "v"), "star-pairs")
    texts = _texts(likely.select(F.col("u").alias("id")).union(likely.select("v")).distinct(), docs, nodes, "star-texts")
    part = stored(components(stored(_verified(likely, texts, size, percent), "star-links")), "star-components")

    slim = stored(_mixed(slim, part).drop("part"), "mixed-tokens")
    texts = _texts(slim.select("id").distinct(), docs, nodes, "mixed-texts")
    named = slim
    for turn in range(ROUNDS):
        named = stored(_mixed(named.select(*slim.columns), part), "round-tokens")
        links = stored(_verified(_star_round(named, traits, percent, turn), texts, size, percent), "round-links")
        found = links.count()
        if found:
            part = _merged(part, links, "round-components")
        if found <= YIELD * named.select("id").distinct().count():
            break

    named = stored(_mixed(named.select(*slim.columns), part), "cross-tokens")
    lists = named.groupBy("id", "n", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("own"))  # no longer than the prefix
    first_ones = F.transform(F.slice("own", 1, EARLIER), lambda x: x["token"])
    rows = lists.select("id", "n", "part", first_ones.alias("list"), F.posexplode("own").alias("at", "one"))
    rows = rows.select("id", "n", "part", "one.pos", "one.token", F.slice("list", 1, F.least("at", F.lit(EARLIER))).alias("earlier"))
    rows = stored(rows.join(traits, "id"), "cross-candidates")
    pair = (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.part") != F.col("b.part"))
    once = ~F.arrays_overlap("a.earlier", "b.earlier")
    pairs = rows.alias("a").join(rows.alias("b").hint("merge"), pair & place & suffix & once)
    pairs = stored(pairs.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct(), "pairs")
    whole = _joined(pairs, part, lambda some: _verified(some, texts, size, percent))

    rooted = nodes.select("id", "name", "first").join(whole.withColumnRenamed("node", "id"), "id", "left")
    least = rooted.where("root is not null").groupBy(F.col("root").alias("value")).agg(F.min("first").alias("least"), F.count("*").alias("n"))
    least = stored(least, "component-least")
    named = attach(rooted.select("name", "first", "root"), least, "root", ["least"], lookup_rows=least.count())
    chosen = stored(named.select("name", F.coalesce("least", "first").alias("least")), "component-names")
    out = summaries.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "name").join(chosen, "name", "left")
    alone = F.col("least").isNull()
    first = alone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    return out.select("doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), first.alias("first"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component; rows without words stay."""
    return without(docs, stored(similar_groups(docs, size, percent).where(~F.col("first")).select("doc_id", "text_key").distinct(), "near-copies"))
