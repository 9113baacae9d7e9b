"""Packing of token sequences by minimum bin slack.

A document's ids and an end mark are cut into whole windows and a rest. Whole windows are sequences of their own. Rests are dealt to groups of
about ``GROUP`` by a hash, and a task fills window after window: the longest rest left goes in first, then a subset sum over the lengths
left (bit s of an integer is set if lengths can add up to s) finds the fullest filling, and walking back through the integers tells how many of each
length it takes. If even the fullest filling leaves room, as when one length holds a third of all rows, a piece is cut to close it, so only
the last window of a group has padding; and that one has none if its filling is a power of two.

Texts are tokenised once, and the ids of the rests are stored beside their lengths. A group sees lengths only; pieces that were cut later fetch the ids of
their rest by row number for their checksum.

Edge cases: an empty table gives no pieces; a null or empty text is its end mark alone; rows that repeat id and text are packed each (their
pieces are interchangeable); ties go to the order of lengths and rows; very long texts become many windows, in one task a text; strings of special
tokens in a text are ordinary text; columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import bounded, stored, text_or_empty

WINDOW = 2048
GROUP = 20_000
END = 1
VOCABULARY = "byte_bpe_50k.json"
ENCODED_AT_ONCE = 1 << 18
"""Characters given to the tokenizer at once."""
TEXTS_AT_ONCE = 500
KNOWN_WORDS = 700_000
"""Words whose ids a Python worker remembers before it starts anew; the generation before stays for reference."""

SPLIT = re.compile(r"(?<=\S)(?= \S)")
TAILS = ".,;:!?"
LETTERS_BELOW = "\u0250"
"""Letters of Latin scripts, which every version of Unicode agrees on."""


def _byte_letters() -> list[str]:
    """The printable character by which a byte-level vocabulary writes each byte: the byte's own, or the next one from 256 on."""
    own = [chr(b).isprintable() and not chr(b).isspace() and b != 0xAD for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b) if own[b] else chr(next(spare)) for b in range(256)]


BYTE_LETTERS = dict(enumerate(_byte_letters()))
SPACE = BYTE_LETTERS[32]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids of texts, as little-endian 32-bit integers.

    A byte-level vocabulary never joins what a single space or line end between two other characters parts, nor a letter with the mark behind it. So
    a text is a sequence of words, and each different word is encoded once. Vocabularies with another way of splitting get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        splitter = parts.get("pre_tokenizer") or {}
        self.by_word = parts.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) \
            and not splitter.get("add_prefix_space", False)
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.older_spaced: dict[str, bytes] = {}
        self.older_bare: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.line_end = self._plain("\n")

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _whole(self, texts: Sequence[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= ENCODED_AT_ONCE):
                size += len(texts[to])
                to += 1
            for e in self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False):
                yield array("I", e.ids).tobytes()
            at = to

    def _word(self, word: str, spaced: bool) -> bytes | None:
        """A word between spaces; None if more white space is next to them, which tokens may span."""
        known, older = (self.spaced, self.older_spaced) if spaced else (self.bare, self.older_bare)
        found = known.get(word)
        if found is None:
            found = older.get(word)
            if found is None:
                return self._new(word, spaced, known)
            known[word] = found
        return found

    def _new(self, word: str, spaced: bool, known: dict[str, bytes]) -> bytes | None:
        core = word.rstrip(TAILS)
        if core.isalpha() and (core.isascii() or max(core) < LETTERS_BELOW):
            if len(core) < len(word):
                found = self._word(core, spaced) + self._word(word[len(core) :], False)
            else:
                letters = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
                found = array("I", [t.id for t in self.tokenize(SPACE + letters if spaced else letters)]).tobytes()
        elif "\n" in word:
            lines = [None if not line else self._word(line, spaced and not i) for i, line in enumerate(word.split("\n"))]
            if None in lines:
                return None
            return self.line_end.join(lines)
        elif not word or word[0].isspace() or word[-1].isspace():
            return None
        else:
            found = self._plain(" " + word if spaced else word)
        known[word] = found
        return found

    def _text(self, text: str) -> bytes:
        words = text.split(" ")
        ids = [self._word(words[0], False), *map(self.spaced.get, words[1:])]
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            found = self._word(words[at], True) if at else None
            if found is None:
                return b"".join([self._loose(part) for part in SPLIT.split(text)])
            ids[at] = found
        return b"".join(ids)

    def _loose(self, part: str) -> bytes:
        found = self._word(part[1:], True) if part[:1] == " " else self._word(part, False) if " " not in part else None
        return self._plain(part) if found is None else found

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        if not self.by_word:
            yield from self._whole(texts)
            return
        for text in texts:
            if len(self.spaced) + len(self.bare) > KNOWN_WORDS:
                self.older_spaced, self.older_bare = self.spaced, self.bare
                self.spaced, self.bare = {}, {}
            yield self._text(text)


@cache
def worker_ids(path: str) -> Ids:
    """The ``Ids`` of this Python process: Spark gives it one task after another, and they share what it has learned."""
    return Ids(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, window: int, path: str, end: int) -> DataFrame:
    """Whole windows and the rest of each document, with their checksums, and the ids of rests."""
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_ids(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                out = []
                for row, encoded in enumerate(ids.encode(texts[at : at + TEXTS_AT_ONCE]), at):
                    encoded += mark
                    tokens = len(encoded) // 4
                    for start in range(0, tokens, window):
                        part = encoded[4 * start : 4 * (start + window)]
                        out.append((row, start, len(part) // 4, zlib.crc32(part), tokens, part if len(part) < 4 * window else None))
                rows, *numbers, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in numbers], pa.array(kept, pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return chosen.mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the lengths in ``counts`` that fills ``room`` best: length -> how many of it.

    Longest lengths first, until some filling is exact. ``reach[i]`` has bit s set if the first i lengths can add up to s.
    """
    lengths = [n for n in sorted(counts, reverse=True) if n <= room and counts[n]]
    within = (1 << room + 1) - 1
    reach = [1]
    for n in lengths:
        now, left, some = reach[-1], min(counts[n], room // n), 1
        while left:  # counts in binary steps: 1, 2, 4, .. and the remainder
            some = min(some, left)
            now |= now << n * some & within
            left, some = left - some, some * 2
        reach.append(now)
        if now >> room & 1:
            break
    total, taken = reach[-1].bit_length() - 1, {}
    for i in range(len(reach) - 1, 0, -1):
        n, k = lengths[i - 1], 0
        while not reach[i - 1] >> total & 1:
            total, k = total - n, k + 1
        if k:
            taken[n] = k
    return taken


def min_slack(lengths: Sequence[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start within the item, length). All are full, but for the last one.

    Every filling starts with the longest item left. A gap that no filling closes is closed by a cut of the longest item that is left then; its rest
    stays to be packed.
    """
    stacks: dict[int, list[tuple[int, int]]] = {}
    for item in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[item], []).append((item, 0))
    counts = {n: len(s) for n, s in stacks.items()}
    longest = max(counts, default=0)
    out: list[list[tuple[int, int, int]]] = []

    def take(n: int) -> tuple[int, int]:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return stacks[n].pop()

    while counts:
        while longest not in counts:
            longest -= 1
        filled = [(*take(longest), longest)]
        room = window - longest
        for n, k in fullest(counts, room).items():
            filled += [(*take(n), n) for _ in range(k)]
            room -= n * k
        if room and counts:
            n = max(counts)
            item, start = take(n)
            filled.append((item, start, room))
            stacks.setdefault(n - room, []).append((item, start + room))
            counts[n - room] = counts.get(n - room, 0) + 1
        out.append(filled)
    return out


PLACED = "doc_id long, row long, start long, within long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut boolean"


def _checksums(cut: DataFrame, pieces: DataFrame) -> DataFrame:
    """``cut`` with the checksums of its pieces, from the ids of the rests they are cut from."""
    rows = stored(cut.select("row").distinct(), "cut-rows")
    rests = pieces.select("row", "ids").join(F.broadcast(rows) if bounded(rows) else rows.hint("merge"), "row", "left_semi")
    both = cut.join(rests, "row").select(*cut.columns, "ids")
    names = cut.columns
    place = {name: i for i, name in enumerate([*names, "ids"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(batch.column(place["ids"]), batch.column(place["within"]).to_pylist(), batch.column(place["length"]).to_pylist())
            sums = [zlib.crc32(ids.as_buffer()[4 * at : 4 * (at + n)]) for ids, at, n in parts]
            columns = list(batch.columns[:-1])
            columns[place["ids_crc32"]] = pa.array(sums, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(run, PLACED)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """A row per piece: its document, place there, checksum, sequence and offset. ``tokenizer``: path of a vocabulary file that executors reach."""
    path = tokenizer or vocabulary_path()
    cut = stored(pieces(docs, window, path, end).withColumn("row", F.monotonically_increasing_id()), "token-pieces")
    groups = max(1, -(-cut.count() // GROUP))
    dealt = cut.drop("ids").withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        lengths = table.column("length").to_pylist()
        base, out = keys[0].as_py() << 32, []
        for number, filled in enumerate(min_slack(lengths, window)):
            offset = 0
            for item, within, length in filled:
                out.append((item, within, length, base + number, offset, length < lengths[item]))
                offset += length
        item, within, length, sequence, offset, parted = zip(*out)
        table = table.take(pa.array(item))
        start = pa.array(np.array(table.column("start")) + np.array(within))
        whole = [pa.array(c, pa.int64()) for c in (within, length, sequence, offset)]
        return pa.Table.from_arrays(
            [table.column("doc_id"), table.column("row"), start, whole[0], whole[1], table.column("ids_crc32"), table.column("doc_tokens"),
             whole[2], whole[3], pa.array(parted)],
            ["doc_id", "row", "start", "within", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"])

    placed = stored(dealt.groupBy("group").applyInArrow(run, PLACED), "token-places")
    summed = placed.where(~F.col("cut")).unionByName(_checksums(placed.where("cut"), cut))
    return summed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
