"""Operators on whole documents against brute force, on texts with every awkward trait."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import digest_index, histogram_sort, jaccard_join, packing, suffix_dedup, words
from tabsmith.llm.common import release_scratch, scratch_path, text_key
from tabsmith.llm.components import components

from .conftest import nasty_texts, prose, table

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def multiset(rows):
    return collections.Counter(map(tuple, rows))


def test_words_and_shingles():
    texts = ["a  B\tc", "", None, "one", "x" * 3_000_000 + " y", "a b c d e a b c d e"]
    for w in words.words(pa.array(texts)):
        for i in range(w.texts):
            expected = re.findall(r"[^\x20\x09-\x0D]+", texts[w.first + i] or "")
            assert w.begin[i + 1] - w.begin[i] == len(expected)
    again = {}
    for w in words.words(pa.array(["b a B"])):
        again = w.hash
    assert again[0] == again[2] != again[1]
    (w,) = words.words(pa.array(["a b c a b c", "a b", "", "a B c"]))
    text, value = words.distinct(*words.shingles(w, 3), w.texts)
    assert np.bincount(text, minlength=4).tolist() == [3, 1, 0, 1]
    assert value[text == 3][0] in value[text == 0]


def test_exact_dedup(spark, nasty, nothing):
    index = digest_index.DigestIndex(spark, scratch_path(spark, "index"), buckets=4)
    batch = digest_index.digests(nasty)
    index.add(batch)
    assert index.add(batch).count() == 0, "a repeated batch adds nothing"
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in nasty_texts():
        groups[norm(t)].append(i)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = collections.Counter()
    done = set()
    for i, t in sorted(nasty_texts(), key=lambda x: (x[0] is None, x[0] or 0)):
        key = norm(t)
        kept = i == first[key] and key not in done
        done |= {key} if kept else set()
        expected[i, first[key], len(groups[key]), kept, hashlib.sha256(key.encode()).hexdigest()] += 1
    got = index.kept(batch).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    assert multiset(got) == expected
    assert index.kept(digest_index.digests(nothing)).count() == 0
    files = spark.read.format("binaryFile").load(index.location).count()
    again = digest_index.DigestIndex(spark, index.location, buckets=4)
    assert again.rows().count() == len(groups) and files > 0, "the index outlives its handle"


def test_keep_first(spark, nasty, nothing):
    index = digest_index.DigestIndex(spark, scratch_path(spark, "index"), buckets=4)
    kept = digest_index.keep_first(nasty, index).cache()
    assert kept.columns == nasty.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in nasty_texts():
        groups[norm(t)].append(i)
    expected = {(t, min((i for i in ids if i is not None), default=None)) for t, ids in groups.items()}
    got = [(norm(r["text"]), r["doc_id"]) for r in kept.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert digest_index.keep_first(nasty, index).count() == 0, "all texts are known by now"
    assert digest_index.keep_first(nothing, index).count() == 0


def brute_groups(texts, size, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(texts)]


def test_jaccard_join(spark, nasty, nothing):
    texts = nasty_texts()
    for size, percent in ((4, 85), (5, 80)):
        got = jaccard_join.similar_groups(nasty, size, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert multiset(got) == multiset(brute_groups(texts, size, percent))
    assert jaccard_join.similar_groups(nothing).count() == 0
    kept = jaccard_join.one_of_each(nasty, 5, 80)
    assert kept.columns == nasty.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    near = [i for i in ids if i is not None and 300 <= i < 320]
    assert near == [300] and {1, 2, 3, 9, 14} <= set(ids), "one near copy stays, and rows without words"


def test_chains_of_links(spark):
    """Copies that drift: neighbours are linked, ends are not; all are one component."""
    words_ = prose(11, 200).split()
    texts = []
    for k in range(60):
        texts.append((1000 - k, " ".join(words_)))
        words_[(3 * k) % 200] = f"w{k}"
    got = jaccard_join.similar_groups(table(spark, texts).repartition(5), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert multiset(got) == multiset(brute_groups(texts, 4, 85))


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert all(got[k] == 0 for k in range(401)) and all(got[k] == 1000 for k in range(1000, 1100)) and 5000 not in got


def test_suffix_dedup(spark, nasty, nothing, monkeypatch):
    texts = [(i, t) for i, t in nasty_texts() if t is None or len(t) < 100_000]
    stretch = prose(77, 80).encode()
    texts += [(700 + k, prose(600 + k, 10) + " " + stretch[k * 9 : k * 9 + 198 + k].decode(errors="ignore") + " " + prose(700 + k, 10)) for k in range(24)]
    places = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in texts]
    for _, b in data:
        places.update(b[s : s + 200] for s in range(len(b) - 199))
    expected = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if places[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        expected.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    docs = table(spark, texts).repartition(4)
    for crowd, bucket, piece in ((20_000, 32 << 20, 1 << 19), (3, 2_000, 1 << 19), (20_000, 5_000, 700)):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        got = suffix_dedup.without_repeats(docs).collect()
        assert multiset((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == multiset(expected)
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_copies_are_cut_into_even_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    hot = prose(31, 80)
    texts = [(k if k % 2 else None, hot) for k in range(2000)] + [(5000 + k, prose(5000 + k, 80)) for k in range(1000)]
    docs = table(spark, texts).repartition(4).cache()
    total = sum(len(t) for _, t in texts)
    splitters = suffix_dedup.sampled_splitters(docs, total)
    sizes = [r["count"] for r in suffix_dedup.places(docs, splitters).groupBy("bucket").count().collect()]
    assert max(sizes) < 4 * sum(sizes) / (len(splitters) + 1)
    got = suffix_dedup.without_repeats(docs)
    kept = {r["doc_id"] for r in got.where("length(kept) > 0").select("doc_id").collect()}
    assert kept == set(range(5000, 6000)) and got.count() == 3000


def test_multikey_order():
    draw = np.random.default_rng(1)
    keys = [draw.integers(0, n, 5000).astype(np.uint64) for n in (3, 10, 100)]
    order = suffix_dedup.multikey_order(keys)
    rows = np.stack([k[order] for k in keys], axis=1)
    assert [tuple(r) for r in rows] == sorted(map(tuple, np.stack(keys, axis=1)))


def test_histogram_shards(spark, nasty, nothing):
    texts = nasty_texts() + [(5000 + k, "heavy " * 4000) for k in range(300)]  # one text holds most bytes
    docs = table(spark, texts).repartition(6)
    for shards, piece in ((6, 1 << 30), (6, 200_000), (1, 1 << 30)):
        dealt = histogram_sort.histogram_shards(docs, shards, piece_bytes=piece)
        rows = dealt.select("doc_id", "text", "shard", "slot", histogram_sort.row_size().alias("size"), text_key().alias("key")).collect()
        assert multiset((r["doc_id"], r["text"]) for r in rows) == multiset(texts)
        total = sum(r["size"] for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r)
        assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
        heaviest = 8 + max(len((t or '').encode()) for _, t in texts)
        assert all(abs(sum(r["size"] for r in v) - total / shards) <= 0.02 * total / shards + heaviest for v in by.values())
        order = [(r["key"], r["doc_id"] if r["doc_id"] is not None else -(1 << 63)) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
        assert order == sorted(order)
    assert histogram_sort.histogram_shards(nothing, 4).count() == 0
    assert [zlib.crc32(b"")] == [r[0] for r in spark.range(1).select(F.crc32(F.lit("").cast("binary"))).collect()]


def test_packing(spark, nasty, nothing):
    lengths = (64, 256, 1024)
    placed = packing.pack(nasty, lengths).collect()
    per = collections.Counter()
    for r in placed:
        per[r["doc_id"]] += r["length"]
    expected = collections.Counter()
    for i, t in nasty_texts():
        expected[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    assert per == expected
    bins = collections.defaultdict(list)
    for r in placed:
        bins[r["bin"]].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r["position"])
        ends = [0, *np.cumsum([r["length"] for r in rows]).tolist()]
        assert [r["position"] for r in rows] == ends[:-1]
        assert rows[0]["bin_used"] == ends[-1] and rows[0]["bin_length"] == min(c for c in lengths if c >= ends[-1])
    whole = packing.sequences(packing.pack(nasty, lengths)).collect()
    assert sum(len(r["parts"]) for r in whole) == len(placed)
    assert packing.pack(nothing).count() == 0


def test_best_fit_beats_one_length():
    draw = np.random.default_rng(3)
    sizes = sorted(draw.integers(1, 1024, 3000).tolist(), reverse=True)
    cost = lambda p: sum(p[2]) + packing.OVERHEAD * len(p[2])
    joint = cost(packing.cheapest(sizes, (128, 256, 512, 1024)))
    assert joint <= min(cost(packing.best_fit(sizes, (128, 256, 512, 1024), r)) for r in packing.REUSE)
    assert joint <= cost(packing.best_fit(sizes, (1024,), 1.0))
    assert joint >= sum(sizes)


def test_release(spark):
    from pathlib import Path

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = Path(path.removeprefix("file:"))
    assert local.exists()
    release_scratch(spark)
    assert not local.exists()


def near_copies(count: int, length: int, changes: int) -> list[tuple[int, str]]:
    base, draw = prose(9, length).split(), random.Random(count)
    out = []
    for i in range(count):
        changed = list(base)
        for at in draw.sample(range(length), changes):
            changed[at] = f"c{i}x{at}"
        out.append((i, " ".join(changed)))
    return out


@pytest.mark.parametrize("length, changes", [(40, 1), (120, 2)])
def test_candidates_of_near_copies_grow_with_their_number(spark, monkeypatch, length, changes):
    """The pairs of the first stars and of the join proper, and the links of the rounds, in a group three times as large."""
    looked_at: dict[str, int] = {}
    whole = jaccard_join.stored

    def counting(df, name, *more):
        out = whole(df, name, *more)
        if name in ("star-pairs", "round-links", "pairs"):
            looked_at[name] = looked_at.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", counting)
    totals = []
    for count in (300, 900):
        looked_at.clear()
        texts = near_copies(count, length, changes)
        found = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(table(spark, texts).repartition(4), 5, 80).collect()}
        totals.append(sum(looked_at.values()))
        if count == 300:
            assert found == {i: c for i, _, c in brute_groups(texts, 5, 80)}
    assert totals[1] <= 4.5 * totals[0] + 50
