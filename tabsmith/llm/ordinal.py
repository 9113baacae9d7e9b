"""Ordinal quality classifier: cumulative-link (proportional odds) regression on hashed texts.

Ratings are graded 0 to ``grades - 1``. One weight per hashed text feature is shared by all grades, and ordered
thresholds cut the score: P(grade <= k) = 1 / (1 + exp(score - threshold_k)). The expected grade and the probability
of the best grade follow from the same score; rows are selected by that tail probability.

Features (present or not): words without case, their first 3, 4 and 5 bytes, the punctuation that words end with, and steps of
the shares of capitals and of repeated words. Only features whose presence depends on the grade beyond chance
(likelihood ratio ``G2``) get a weight. The fit is L-BFGS; each evaluation is one pass of Spark over the rated rows.

Bounds: the fit takes at most about ``SAMPLE`` rated rows, drawn by a hash of their ids; scoring covers every row and
whole texts. Edge cases: ratings with a null are not used; a text rated twice counts twice; without ratings of two
grades at least there is no model, every score is 0 and every row has tail probability 1, so none is rejected; a null
or empty text has no words and is scored by the thresholds alone; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import stored
from tabsmith.llm.words import FOLDED_CODES, WHITE, Words, distinct, mix, prefix_hashes, span_hashes, words

SAMPLE = 20_000
BITS = 18
PREFIXES = (3, 4, 5)
G2 = 40.0
"""A feature by chance passes this with a probability of 2e-9 (two degrees of freedom); there are 2.6e5 features."""
PENALTY = 1e-4
ROUNDS = 30

PUNCTUATION = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
BREAKS = WHITE | PUNCTUATION


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a slice, in order of texts, not yet distinct."""
    prefix = prefix_hashes(FOLDED_CODES[w.buffer])
    texts, hashes = [w.text], [w.hash]
    for k in PREFIXES:
        long = w.end - w.start > k
        texts.append(w.text[long])
        hashes.append(mix(span_hashes(prefix, w.start[long], w.start[long] + k), k))
    stop = np.flatnonzero(WHITE[w.buffer])  # the last byte of each text's stretch is a space
    last = stop[(stop > 0) & ~WHITE[w.buffer[stop - 1]]] - 1
    last = last[PUNCTUATION[w.buffer[last]]]
    before = np.where(last > 0, w.buffer[last - 1], 32)
    ends = w.ends
    texts.append(np.searchsorted(ends, last))
    pair = w.buffer[last].astype(np.uint64) * np.uint64(256) + np.where(PUNCTUATION[before], before, 0).astype(np.uint64)
    hashes.append(mix(pair, 33))
    begins = np.concatenate(([0], ends[:-1] + 1))
    capitals = np.concatenate(([0], np.cumsum((w.buffer >= 65) & (w.buffer <= 90))))
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    shares = [(capitals[ends] - capitals[begins]) / np.maximum(ends - begins, 1),
              np.bincount(w.text, weights=again, minlength=w.texts) / np.maximum(np.diff(w.begin), 1)]
    short = np.diff(w.begin) < 5  # too few words for a share
    for i, share in enumerate(shares):
        texts.append(np.arange(w.texts))
        hashes.append(mix(np.where(short, 10, np.minimum(share * 10, 9)).astype(np.uint64), 50 + i))
    text, value = np.concatenate(texts), np.concatenate(hashes) >> np.uint64(64 - BITS)
    order = np.argsort(text, kind="stable")
    return text[order], value[order].astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    """By feature; zero for most."""
    thresholds: np.ndarray
    """Ascending; ``grades - 1`` of them. Empty: no model."""

    def text_scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        used = self.weights != 0
        for w in words(column, breaks=BREAKS):
            text, feature = features(w)
            some = used[feature]
            text, feature = distinct(text[some], feature[some], w.texts)
            out[w.first : w.first + w.texts] = np.bincount(text, weights=self.weights[feature], minlength=w.texts)
        return out

    def score(self, text: str = "text") -> Column:
        """struct(expected, tail) of a text column."""
        model = self

        @F.arrow_udf("struct<expected: double, tail: double>")
        def run(column: pa.Array) -> pa.Array:
            if not len(model.thresholds):
                return pa.StructArray.from_arrays([pa.array(np.zeros(len(column))), pa.array(np.ones(len(column)))], ["expected", "tail"])
            above = 1 - _sigmoid(model.thresholds[None, :] - model.text_scores(column)[:, None])
            return pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, -1])], ["expected", "tail"])

        return run(F.col(f"`{text}`"))


def _featurised(rated: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), breaks=BREAKS):
                text, feature = distinct(*features(w), w.texts)
                at = np.searchsorted(text, np.arange(w.texts + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(w.first, w.texts).cast(pa.int32()), lists], ["grade", "features"])

    return rated.select("text", "grade").mapInArrow(run, "grade int, features array<int>")


def _informative(rows: DataFrame, sizes: np.ndarray) -> np.ndarray:
    """Features whose presence depends on the grade."""
    grades = len(sizes)
    counts = [F.sum((F.col("grade") == k).cast("long")).alias(f"n{k}") for k in range(grades)]
    counted = rows.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(*counts)
    total = float(sizes.sum())
    seen = sum((F.col(f"n{k}") for k in range(grades)), F.lit(0))

    def part(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    terms = F.lit(0.0)
    for k, size in enumerate(sizes):
        if size:
            terms = terms + part(F.col(f"n{k}"), seen * (size / total)) + part(F.lit(float(size)) - F.col(f"n{k}"), (F.lit(total) - seen) * (size / total))
    chosen = counted.where(2 * terms > G2).select("feature").collect()  # at most 2^BITS
    return np.sort(np.array([r["feature"] for r in chosen], np.int64))


def _loss(rows: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum over the rated rows of -log P(grade), and its slopes by weight and threshold. Rows: grade, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, by_weight, by_cut = 0.0, np.zeros(len(weights)), np.zeros(len(thresholds))
        for batch in batches:
            grade = batch.column(0).to_numpy()
            at = batch.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(len(grade)), batch.column(1).value_lengths().to_numpy())
            score = np.bincount(row, weights=weights[at], minlength=len(grade))
            below = np.hstack([np.zeros((len(grade), 1)), _sigmoid(thresholds[None, :] - score[:, None]), np.ones((len(grade), 1))])
            slope = below * (1 - below)
            i = np.arange(len(grade))
            p = np.maximum(below[i, grade + 1] - below[i, grade], 1e-12)
            loss -= np.log(p).sum()
            by_weight += np.bincount(at, weights=((slope[i, grade + 1] - slope[i, grade]) / p)[row], minlength=len(weights))
            padded = np.zeros(len(thresholds) + 2)
            np.add.at(padded, grade + 1, -slope[i, grade + 1] / p)
            np.add.at(padded, grade, slope[i, grade] / p)
            by_cut += padded[1:-1]
        yield pa.RecordBatch.from_arrays([pa.array([[loss, *by_weight, *by_cut]])], ["sums"])

    sums = np.sum([r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)  # a row per task
    return sums[0], sums[1 : 1 + len(weights)], sums[1 + len(weights) :]


def _minimise(value, start: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps. ``value(x)``: loss and gradient."""
    x = start
    f, g = value(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, parts = g.copy(), []
        for s, y in reversed(moves):
            parts.append(a := (s @ d) / (y @ s))
            d -= a * y
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1e-12, np.linalg.norm(g))
        for (s, y), a in zip(moves, reversed(parts)):
            d += s * (a - (y @ d) / (y @ s))
        step = 1.0
        while True:
            nx = x - step * d
            nf, ng = value(nx)
            if nf <= f - 1e-4 * step * (g @ d) or step < 1e-3:
                break
            step /= 2
        if nf >= f or f - nf < 1e-6 * abs(f):
            return nx if nf < f else x
        if (nx - x) @ (ng - g) > 1e-12:
            moves = [*moves, (nx - x, ng - g)][-memory:]
        x, f, g = nx, nf, ng
    return x


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE, rounds: int = ROUNDS) -> OrdinalModel:
    """Model of ``ratings(doc_id, grade)`` of the texts of ``docs(doc_id, text)``."""
    none = OrdinalModel(np.zeros(1 << BITS), np.zeros(0))
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).select(F.col("doc_id").alias("__id"), "grade")
    there = rated.count()
    if there > sample:
        share = int(0.97 * sample / there * 1_000_000)
        rated = rated.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < share)
    rated = F.broadcast(rated.limit(sample))  # bounded by the sample
    rows = stored(_featurised(docs.select("doc_id", "text").join(rated, F.col("doc_id") == F.col("__id"))), "rated")
    found = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(found) < 2:
        return none
    present = sorted(found)
    sizes = np.array([found[k] for k in present], float)
    ranks = F.create_map(*[F.lit(x).cast("int") for pair in ((k, i) for i, k in enumerate(present)) for x in pair])
    rows = rows.withColumn("grade", ranks[F.col("grade")])
    chosen = _informative(rows, sizes)
    if not len(chosen):
        return none

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            at = np.searchsorted(chosen, value)
            some = chosen[np.minimum(at, len(chosen) - 1)] == value
            ends = np.searchsorted(row[some], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[some].astype(np.int32)))], ["grade", "at"])

    slim = stored(rows.mapInArrow(numbered, "grade int, at array<int>").coalesce(8), "rated-slim")
    n, m = sizes.sum(), len(chosen)
    shares = np.cumsum(sizes)[:-1] / n
    cuts = np.log(shares / (1 - shares))

    def unpack(x: np.ndarray) -> np.ndarray:  # the first threshold and the logs of the gaps keep them in order
        return np.concatenate(([x[m]], x[m] + np.cumsum(np.exp(x[m + 1 :]))))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, by_weight, by_cut = _loss(slim, x[:m], unpack(x))
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate((by_weight / n + PENALTY * x[:m], [tails[0] / n], tails[1:] * np.exp(x[m + 1 :]) / n))
        return loss / n + PENALTY / 2 * (x[:m] @ x[:m]), gradient

    start = np.concatenate((np.zeros(m), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))))
    best = _minimise(value, start, rounds)
    weights = np.zeros(1 << BITS)
    weights[chosen] = best[:m]
    cut_at, below = unpack(best), np.searchsorted(present, np.arange(grades - 1), "right")
    thresholds = np.array([-30.0 if i == 0 else 30.0 if i == len(present) else cut_at[i - 1] for i in below])  # grades never given
    return OrdinalModel(weights, thresholds)


def rating(quality: Column, toxic: Column) -> Column:
    """Grades of the labels: 0 harmful, 1 poor, 2 good; null if a label is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic != 0, 0).when(quality == 0, 1).otherwise(2).cast("int")


def select_good(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows whose text is of the best grade with a probability of ``least`` or more."""
    return docs.where(model.score()["tail"] >= least)
