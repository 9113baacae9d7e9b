"""Vector codes, conversation repair and slack packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from itertools import product

import numpy as np
import pytest

from tabsmith.llm import slack_packing, turn_repair, vector_codes
from tabsmith.llm.queries import CATALOG

# ---------------------------------------------------------------- vector codes


def brute_codes(rows, entries=256, parts=4, rounds=4):
    """Python integers and full scans: {vec_id: [(code, error, label)]} and the digest of the codebooks."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(books[p], c[p])[1], []).append(c[p])
            for k, xs in members.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        best = [near(books[p], c[p]) for p in range(parts)]
        out.append((i, bytes(k for _, k in best).hex(), sum(d for d, _ in best), label))
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def vectors(n, seed=5, width=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + 0.3 * draw.normal(size=width)).astype(np.float32).tolist()
        rows.append((i, v, i % 5 if i % 7 else None))
    return rows


FIELDS = "vec_id long, embedding array<float>, label int, code string, error long, n long, value int, __vector int"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in rows], FIELDS)


def test_codes_against_brute_force(spark, tmp_path):
    rows = vectors(330)
    rows += [(700, None, 1), (701, [], 1), (702, [None] * 16, 1), (703, [float("nan")] * 16, 2), (704, [float("inf")] + [0.0] * 15, 2)]
    rows += [(800 + k, rows[3][1], 9) for k in range(120)]  # a hot vector, with equal distances
    rows += [(-5, [-0.0005] * 16, None), (None, rows[4][1], 3), (6, rows[6][1], 3)]
    vector_table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = CATALOG.queries["op11_sliced_codes"](spark, str(tmp_path)).collect()
    expected, digest = brute_codes([r for r in rows if r[1] != []])
    per_label = {}
    for _, _, e, label in expected:
        per_label[label] = per_label.get(label, 0) + e
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted([(i, c, e, per_label[label]) for i, c, e, label in expected], key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_few_rows_large_numbers_and_none(spark, tmp_path):
    rows = [(1, [1e30, 2.0, 3.0, 4.0], 1), (2, [1e4, -1e4, 5e3, 0.1], 1), (3, [3.4e38, -3.4e38, 0.0, 1.0], 2), (4, [1.0, 2.0, 3.0, 4.5], 2), (5, [1.0, 2.0], 2)]
    model = vector_codes.fit(vector_table(spark, rows), entries=3)
    got = {r["vec_id"]: (r["code"].hex(), r["error"]) for r in model.encode(vector_table(spark, rows), keep=["vec_id"]).collect()}
    floats = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows[:4]]
    expected, digest = brute_codes(floats, entries=3)
    assert got == {i: (c, min(e, (1 << 63) - 1)) for i, c, e, _ in expected}
    assert model.sha256() == digest and 5 not in got
    assert vector_codes.fit(vector_table(spark, [])) is None
    vector_table(spark, [(1, None, 1)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert CATALOG.queries["op11_sliced_codes"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("width, entries, radius", [(1, 1, 1), (3, 65, 1), (16, 256, 4000), (7, 130, 50)])
def test_sliced_codebook_is_exact(width, entries, radius):
    draw = np.random.default_rng(width)
    book, x = draw.integers(-300, 300, (entries, width)), draw.integers(-900, 900, (500, width))
    x[:entries // 2] = book[:entries // 2][: len(x)]
    book[-1] = book[0]  # a tie
    code, apart = vector_codes.SlicedCodebook(book, radius).nearest(x)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()


# ---------------------------------------------------------------- conversations

WHITE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest_edits(rows):
    """Cost, edits and rows by a search of all lists of edits, cheapest and then ASCII-least first."""
    import heapq

    # (cost, audit, position, state, kept): uniform cost search; among equal costs the least audit is found by comparing all.
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}
    heap = [(0, "", 0, "", ())]
    answers = []
    limit = None
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        known = best.get((at, state))
        if known is not None and known <= (cost, audit):
            continue
        best[at, state] = (cost, audit)
        if at == len(rows) and state in ("", "a"):
            limit = cost
            answers.append((audit, kept))
        for role in ("user", "assistant"):
            if role[0] in after[state] and role[0] != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*kept, (role, ""))))
        if at < len(rows):
            role, text, must_go, short = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, kept))
            if not must_go:
                extra = 5 if short else 0
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[0], (*kept, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in after[state]:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, new[0], (*kept, (new, text))))
    audit, kept = min(answers)
    return limit, audit, kept


def brute_repair(rows):
    damaged = brute_damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in damaged if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1] + "\0" + r[2]))
        seen, judged = set(), []
        blank = duplicate = truncated = 0
        for _, role, text in mine:
            end = text.rstrip(WHITE)
            if not end:
                blank += 1
                judged.append((role, text, True, False))
            elif (role, text) in seen:
                duplicate += 1
                judged.append((role, text, True, False))
            else:
                short = end[-1] not in ".!?"
                truncated += short
                judged.append((role, text, False, short))
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit, kept = cheapest_edits(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return out


def conversation_rows(count, seed=3):
    draw = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(draw.choice([1, 2, 3, 5, 8])):
            if draw.random() < 0.1:
                continue
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = draw.choice(["Same.", "Same.", f"Text {conv} {turn}!", "no end", "  ", None, "Ends? \n", "ünï."])
            rows.append((conv, draw.choice([turn, turn, turn, None, turn * 3]), role, text))
    rows += [(None, None, "user", "Null."), (None, 1, "assistant", "Fine."), (-9, 1 << 62, "system", "Far."), (-9, -(1 << 62), "user", "Far?")]
    return rows


TURNS = "conv_id long, turn long, role string, text string, part int, cost long, gone boolean, __row long"


def conversation_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, True, 3) for r in rows], TURNS)


def reports(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_repair_against_brute_force(spark, tmp_path):
    rows = conversation_rows(150)
    expected = brute_repair(rows)
    conversation_table(spark, rows).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = CATALOG.queries["op12_turn_repair"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = reports(got)
    assert got.count() == len(expected)
    assert found[-9][0] == (1 << 63) - 1 if expected[-9][0] > (1 << 63) - 1 else found[-9] == expected[-9]
    found.pop(-9), expected.pop(-9)
    assert found == expected
    # Every conversation in blocks of two rows: the same through the checkpoints between blocks.
    small = reports(turn_repair.repaired(turn_repair.damaged(conversation_table(spark, rows).repartition(3)), most_rows=2))
    small.pop(-9)
    assert small == expected


def test_repair_of_a_long_conversation_and_of_none(spark):
    draw = random.Random(8)
    rows = [(7, t, draw.choice(["user", "assistant"]), draw.choice(["Hot.", f"Own {t}.", "cut", f"cut {t}"])) for t in range(3000)]
    rows += [(8, None, None, None)] * 500 + [(9, 1, "user", "Yes."), (9, 2, "assistant", "No.")]
    table = conversation_table(spark, rows)
    one, many = (reports(turn_repair.repaired(turn_repair.damaged(table.repartition(n)), most_rows=m)) for n, m in ((1, 100_000), (6, 37)))
    assert one == many and set(one) == {7, 8, 9}
    assert one[8][1] == len([r for r in brute_damage(rows) if r[0] == 8])
    assert turn_repair.repaired(turn_repair.damaged(conversation_table(spark, []))).collect() == []


def test_walk_checkpoints_do_not_matter():
    for roles in product("sua", repeat=4):
        turns = [turn_repair.Turn({"s": "system", "u": "user", "a": "assistant"}[r], f"{i}.", i == 2, i == 1) for i, r in enumerate(roles)]
        edits, kept, state = turn_repair.walk(turns, turn_repair.START, turn_repair.last_vector())
        more, extra = turn_repair.finish(state)
        cost, audit, rows = cheapest_edits([tuple(t) for t in turns])
        assert ("".join(edits + more), tuple(kept + extra)) == (audit, rows)
        assert turn_repair.backward(reversed(turns), turn_repair.last_vector())[turn_repair.START] == cost


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(slack_packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, texts, ids, window=2048):
    """Every id in one piece with its checksum, sequences gapless and within the window; returns the padding of each sequence."""
    documents = sorted(((i is not None, i or 0, tuple(ids(t))) for i, t in texts))
    pieces = {}
    for r in rows:
        assert 0 < r["length"] <= window
        pieces.setdefault((r["doc_id"] is not None, r["doc_id"] or 0), []).append(r)
    by_id = {}
    for known, i, tokens in documents:
        by_id.setdefault((known, i), []).append(tokens)
    assert set(by_id) == set(pieces)
    for key, found in pieces.items():
        used = 0
        for r in found:
            options = [t for t in by_id[key] if len(t) == r["doc_tokens"]]
            at = slice(r["start"], r["start"] + r["length"])
            assert r["ids_crc32"] in {zlib.crc32(np.array(t[at], "<u4").tobytes()) for t in options}
            used += r["length"]
        assert used == sum(map(len, by_id[key]))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = {}
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding[s] = 0 if at & (at - 1) == 0 else window - at
    return padding


def test_ids_by_word_are_the_tokenizer_s(plain_ids, nasty):
    texts = [r["text"] or "" for r in nasty.select("text").collect()]
    texts += ["", " ", "  a", "a  b", "a \n b", " lead", "trail ", "tab\t x", "a\x1c b", "a \x1cb", "x  y", "x 　y", "it's we'll I'M 12 3.4 !? ...",
              "<|endoftext|>", "a <|endoftext|> b", "日本 語 é é ​ z", "퟿ \U0001f600 ok", "\x85 q", "p ᠎ q", "n   m", "new\nline \r\n end"]
    draw = random.Random(4)
    texts += ["".join(draw.choice("ab '\n\t 1. 　é\x1f ") for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    ids = slack_packing.Ids(slack_packing.vocabulary_path())
    for text, got in zip(texts, ids.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain_ids(text)[:-1], repr(text)


def test_packing_of_nasty_texts(spark, nasty, nothing, plain_ids, tmp_path):
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    got = CATALOG.queries["op13_slack_packing"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    texts = [(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()]
    padding = check_packing(got.collect(), texts, plain_ids)
    assert sum(p > 0 for p in padding.values()) <= 1
    assert slack_packing.pack(nothing).collect() == []


def test_packing_of_one_frequent_length(spark, plain_ids):
    """No two of these fit together, so pieces are cut to close the windows."""
    words = ("one two three four five " * 300).strip()
    texts = [(i, words) for i in range(60)] + [(100, None), (100, ""), (None, "end")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    padding = check_packing(slack_packing.pack(df).collect(), texts, plain_ids)
    assert sum(p > 0 for p in padding.values()) <= 1


def test_fullest_against_every_subset():
    draw = random.Random(2)
    for _ in range(300):
        counts = {draw.randint(1, 40): draw.randint(1, 3) for _ in range(draw.randint(1, 4))}
        room = draw.randint(0, 90)
        taken = slack_packing.fullest(counts, room)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in product(*[range(c + 1) for c in counts.values()])}
        assert all(0 < k <= counts[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_windows_close_and_few_pieces_are_cut():
    draw = random.Random(1)
    lengths = sorted((min(2047, 1 + int(draw.expovariate(1 / 500))) for _ in range(4000)), reverse=True)
    filled = slack_packing.min_slack(lengths)
    assert all(sum(n for *_, n in w) == 2048 for w in filled[:-1])
    assert sum(n < lengths[i] for w in filled for i, _, n in w) < 100
