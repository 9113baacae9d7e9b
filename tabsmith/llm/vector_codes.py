"""Compression of vectors to short codes: product quantisation whose nearest entries come from sliced bitmasks.

A component x becomes the integer floor(scale * x). A vector is cut into ``parts`` consecutive parts, each with a codebook of at
most ``entries`` entries that starts as that part of the smallest ids and moves ``rounds`` times to the floor of its members' mean.

The nearest entry is found by slicing and intersecting. Per dimension the entries' coordinates are sorted, and a table holds for each prefix
of that order the bitmask (uint64 words) of its entries. A slice [x - r, x + r] is two binary searches, and its entries are the difference of two
prefix masks; ANDed over the dimensions, they are the entries in a cube of radius r, and only these are measured. The first r is
the mean distance of the round before. A row whose best candidate is no farther than r is settled, as all others are outside the cube; one with a
farther candidate takes that distance as its next r and is settled then; one without a candidate doubles r.

Every round is one scan of the table. A task adds its members up in one array of the codebooks' size, Spark adds the tasks' arrays,
and the driver holds codebooks only (parts * entries * width numbers, whatever the table).

Edge cases: rows whose vector is null, empty, of another length than that of the smallest id, or holds null or non-finite components are left out; a width
that ``parts`` does not divide is cut as evenly as can be. Null ids come last where the first entries are taken, equal ids go by their vectors.
Fewer rows than ``entries`` give smaller codebooks, no rows an empty result. Very large components are exact too (Python integers);
errors beyond a 64-bit integer read as the greatest one. Columns beside id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.llm.common import stored
from tabsmith.operators.lookup import attach

EXACT = 1 << 23
"""Coordinates below this give squared distances that 64-bit arithmetic, floating or not, holds exactly."""
LIMB = 30
"""Sums beyond 64 bits leave a task in digits of so many bits."""
GREATEST = (1 << 63) - 1
ROWS_AT_ONCE = 4096
DENSE = 24
"""Mean number of candidates from which a block measures them by a matrix product."""


def cuts(width: int, parts: int) -> list[slice]:
    edges = [width * p // parts for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _roots(values: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded up."""
    return np.array([math.isqrt(v - 1) + 1 if v else 0 for v in values.tolist()], dtype=values.dtype)


class SlicedCodebook:
    """Exact nearest entry by slices of sorted coordinates."""

    def __init__(self, entries: np.ndarray, radius: int) -> None:
        self.entries, self.radius = entries, max(int(radius), 1)
        k, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[self.order[:, d], d] for d in range(width)]
        one = np.zeros((k, -(-k // 64)), np.uint64)
        one[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.prefix = [np.concatenate([np.zeros((1, one.shape[1]), np.uint64), np.bitwise_or.accumulate(one[self.order[:, d]], axis=0)])
                       for d in range(width)]
        self.floats = entries.astype(float) if entries.dtype != object else None

    def inside(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(rows, entries): which entries lie in the cube around each row."""
        mask = None
        for d, (values, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(values, x[:, d] - radius, "left")
            high = np.searchsorted(values, x[:, d] + radius, "right")
            part = prefix[high] & ~prefix[low]
            mask = part if mask is None else mask & part
        bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), axis=1, bitorder="little")
        return bits[:, : len(self.entries)].view(bool)

    def _best(self, x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least squared distance among the candidates of each row (each has one), and the first entry that has it."""
        if self.floats is not None and x.dtype != object and inside.sum() > DENSE * len(x):
            points = x.astype(float)
            apart = (points * points).sum(axis=1)[:, None] - 2.0 * (points @ self.floats.T) + (self.floats * self.floats).sum(axis=1)
            apart[~inside] = np.inf
            code = apart.argmin(axis=1)
            return apart[np.arange(len(x)), code].astype(np.int64), code
        row, entry = np.nonzero(inside)
        apart = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(apart, first)
        hit = np.flatnonzero(apart == best[row])
        return best, entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, squared distance) of each row."""
        code, least = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        if x.shape[1] == 0:
            return code, least
        radius = np.full(len(x), self.radius, dtype=x.dtype)
        open_rows = np.arange(len(x))
        while len(open_rows):
            at = x[open_rows]
            inside = self.inside(at, radius[open_rows])
            some = inside.any(axis=1)
            radius[open_rows[~some]] *= 2
            held = open_rows[some]
            if len(held):
                apart, entry = self._best(at[some], inside[some])
                needed = _roots(apart)
                settled = needed <= radius[held]
                code[held[settled]], least[held[settled]] = entry[settled], apart[settled]
                radius[held[~settled]] = needed[~settled]
                open_rows = np.concatenate([open_rows[~some], held[~settled]])
        return code, least


def _integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows whose vector counts, and their integers (Python integers where some are very large)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.frombuffer(column.offsets.buffers()[1], np.int32, len(column) + 1, column.offsets.offset * 4))
    whole = np.array(column.is_valid()) & (lengths == width)
    rows = np.flatnonzero(whole)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = np.array(values.fill_null(np.nan)).reshape(len(rows), width)
    sound = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        values = np.floor(values[sound] * scale)
    return rows[sound], values


def _typed(values: np.ndarray) -> np.ndarray:
    if values.size and not (np.abs(values) < EXACT).all():
        return np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape)
    return values.astype(np.int64)


def _blocks(values: np.ndarray, plain: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in blocks of bounded size, the very large ones apart."""
    large = ~(np.abs(values) < EXACT).all(axis=1) if plain else np.ones(len(values), bool)
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        for at in range(0, len(rows), ROWS_AT_ONCE):
            one = rows[at : at + ROWS_AT_ONCE]
            yield one, (_typed(values[one]) if plain and not large[one[0]] else
                        np.array([int(v) for v in values[one].ravel()], dtype=object).reshape(len(one), -1))


@dataclass
class VectorCodes:
    """Fitted codebooks: one integer array (entries, width of the part) per part."""

    books: list[np.ndarray]
    radius: list[int]
    width: int
    scale: int

    def searches(self) -> list[SlicedCodebook]:
        return [SlicedCodebook(b, r) for b, r in zip(self.books, self.radius)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()

    def encode(self, df: DataFrame, vector: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
        """(``keep``, code binary, error): a byte per part (two beyond 256 entries, big-endian), for the rows that count."""
        books, radius, width, scale = self.books, self.radius, self.width, self.scale
        kind = ">u1" if max((len(b) for b in books), default=0) <= 256 else ">u2"
        keep = list(keep)
        chosen = df.select(*[col(c) for c in keep], col(vector).alias("__vector"))
        schema = chosen.select(*[col(c) for c in keep], F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = VectorCodes(books, radius, width, scale).searches()
            plain = all(b.dtype != object for b in books)
            for batch in batches:
                rows, values = _integers(batch.column(len(keep)), width, scale)
                codes = np.zeros((len(rows), len(books)), np.dtype(kind))
                errors = [0] * len(rows)
                for at, block in _blocks(values, plain):
                    total = 0
                    for p, (one, part) in enumerate(zip(searches, cuts(width, len(books)))):
                        code, apart = one.nearest(block[:, part])
                        codes[at, p] = code
                        total = total + apart
                    for i, e in zip(at.tolist(), total.tolist()):
                        errors[i] = min(e, GREATEST)
                kept = batch.select(list(range(len(keep)))).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64())], [*keep, "code", "error"])

        return chosen.mapInArrow(run, schema)


def _sums(df: DataFrame, vector: str, model: VectorCodes) -> dict[tuple[int, int, int], int]:
    """Sums of the members of each entry: (part, entry, place) -> sum; place -1 counts them, -2 sums distances."""
    books, radius, width, scale = model.books, model.radius, model.width, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = VectorCodes(books, radius, width, scale).searches()
        plain = all(b.dtype != object for b in books)
        small = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        large: dict[tuple[int, int, int], int] = {}
        far = [0.0] * len(books)
        for batch in batches:
            _, values = _integers(batch.column(0), width, scale)
            for _, block in _blocks(values, plain):
                for p, (one, part) in enumerate(zip(searches, cuts(width, len(books)))):
                    x = block[:, part]
                    code, apart = one.nearest(x)
                    far[p] += float(sum(math.sqrt(a) for a in apart.tolist()))
                    if x.dtype == object:
                        for c, row in zip(code.tolist(), x):
                            for place, v in enumerate(row):
                                large[p, c, place] = large.get((p, c, place), 0) + v
                        small[p][:, -1] += np.bincount(code, minlength=len(books[p]))
                    else:
                        order = np.argsort(code, kind="stable")
                        used, first = np.unique(code[order], return_index=True)
                        if len(used):
                            with_one = np.column_stack([x[order], np.ones(len(x), np.int64)])
                            small[p][used] += np.add.reduceat(with_one, first, axis=0)
        out: list[tuple[int, int, int, int, int]] = []
        for p, sums in enumerate(small):
            for e, place in zip(*[i.tolist() for i in np.nonzero(sums)]):
                out.append((p, e, -1 if place == sums.shape[1] - 1 else place, 0, int(sums[e, place])))
            out.append((p, 0, -2, 0, int(far[p])))
        for (p, e, place), v in large.items():
            limb = 0
            while v not in (0, -1) or limb == 0:
                out.append((p, e, place, limb, v & ((1 << LIMB) - 1)))
                v, limb = v >> LIMB, limb + 1
            if v:
                out.append((p, e, place, limb, v))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "limb", "value"])

    fields = "part long, entry long, place long, limb long, value long"
    rows = df.select(col(vector)).mapInArrow(run, fields).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
    total: dict[tuple[int, int, int], int] = {}
    for r in rows:
        key = (r["part"], r["entry"], r["place"])
        total[key] = total.get(key, 0) + (r["value"] << LIMB * r["limb"])
    return total


def _first_radius(book: np.ndarray) -> int:
    """Mean distance of an entry to its nearest other one: where the search of the first round begins."""
    x = book.astype(float)
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    return int(np.sqrt(apart.min(axis=1)).mean()) if len(x) > 1 and np.isfinite(apart.min()) else 1


def fit(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4,
        scale: int = 1024) -> VectorCodes | None:
    """Codebooks over all rows that count; None if there is none."""
    x = col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    order = [col(key).asc_nulls_last(), x.asc()]
    first = df.where(sound).select(col(key), x).orderBy(*order).limit(1).collect()
    if not first:
        return None
    width = len(first[0][1])
    rows = df.where(sound & (F.size(x) == width)).select(col(key), x).orderBy(*order).limit(entries).collect()
    start = np.floor(np.array([r[1] for r in rows], float) * scale)
    books = [_typed(start[:, part]) for part in cuts(width, parts)]
    model = VectorCodes(books, [_first_radius(b) for b in books], width, scale)
    for _ in range(rounds):
        sums = _sums(df, vector, model)
        books = []
        for p, book in enumerate(model.books):
            moved = [[sums.get((p, e, d), 0) // n for d in range(book.shape[1])] if (n := sums.get((p, e, -1), 0)) else list(map(int, row))
                     for e, row in enumerate(book)]
            large = any(abs(v) >= EXACT for row in moved for v in row)
            books.append(np.array(moved, dtype=object if large else np.int64).reshape(book.shape))
        members = max(sum(sums.get((0, e, -1), 0) for e in range(len(model.books[0]))), 1)
        model = VectorCodes(books, [sums.get((p, 0, -2), 0) // members for p in range(len(books))], width, scale)
    return model


def coded(df: DataFrame, model: VectorCodes, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, label, code, error, label_error): ``label_error`` sums the errors of all rows with the same label, nulls together.

    Sums per label are broadcast where they are few, and otherwise joined with frequent labels spread (``attach``)."""
    codes = stored(model.encode(df, vector, [key, label]), "codes")
    total = F.coalesce(F.try_sum("error"), F.lit(GREATEST))
    per_label = codes.groupBy(col(label).alias("value")).agg(total.alias("label_error"), F.count("*").alias("n"))
    per_label = stored(per_label, "label-errors")
    counted = per_label.agg(F.count("*"), F.sum(F.octet_length(F.col("value").cast("string"))), F.sum("n")).first()
    none = per_label.where("value is null").first()
    out = attach(codes, per_label.where("value is not null"), label, ["label_error"],
                 lookup_rows=counted[0], lookup_bytes=counted[1] or 0, total=counted[2] or 0)
    return out.withColumn("label_error", F.coalesce(F.col("label_error"), F.lit(none["label_error"] if none else None)))


def hex_code(name: str = "code") -> Column:
    return F.lower(F.hex(name))
