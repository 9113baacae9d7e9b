"""Repeatable splits and folds of exact size.

The order of the rows by a hash of their key is a shuffle of the table. A split is a cut in that order, so
all that is needed is the hash at the cut. It is found by counting hash prefixes: a few scans that
return small counts. The rows themselves are never sorted or moved, and the split column is a
comparison with a literal.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import as_text, col, hash_text, missing

COLLECT = 50_000
LISTED_CLASSES = 20_000
"""Up to so many classes the cuts are literals. Beyond, they are a joined table and ranks within the classes."""
HEAVY = 1_000
"""With more classes, those with over a thousandth of the rows are still cut by literals."""


def hash_cuts(df: DataFrame, label: Column, hashed: Column, ranks: Mapping[str, Sequence[int]]) -> dict[str, list[str]]:
    """Hash of the row at each one-based rank, per class; classes are few (``LISTED_CLASSES``).

    Every round reads (class, hash) and returns counts per next prefix digits of the ranges that still hold
    a wanted rank. Ranges of at most ``COLLECT`` rows are finished on the driver.
    """
    table = df.select(label.alias("label"), hashed.alias("h"))
    spark = df.sparkSession
    state = {(c, r): ["", r] for c, rs in ranks.items() for r in rs if r > 0}
    sizes: dict[tuple[str, str], int] = {}
    found: dict[tuple[str, int], str] = {}
    digits = max(1, min(3, int(math.log(200_000 / max(len(ranks), 1), 16))))
    while len(found) < len(state):
        open_ranks = {k: v for k, v in state.items() if k not in found}
        ranges = {(c, v[0]) for (c, _), v in open_ranks.items()}
        depth = len(next(iter(ranges))[1])
        small = {x for x in ranges if x in sizes and sizes[x] * len(ranges) <= max(COLLECT, 50 * len(ranges))}
        if depth >= 32:  # rows with equal keys share a hash: the cut is that hash
            found.update({k: v[0] for k, v in open_ranks.items()})
            break
        for part, finish in ((small, True), (ranges - small, False)):
            if not part:
                continue
            wanted = F.broadcast(spark.createDataFrame(sorted(part), "label string, prefix string"))
            rows = table.withColumn("prefix", F.substring("h", 1, depth)).join(wanted, ["label", "prefix"])
            if finish:
                hashes: dict[tuple[str, str], list[str]] = {}
                for row in rows.select("label", "prefix", "h").collect():
                    hashes.setdefault((row["label"], row["prefix"]), []).append(row["h"])
                for k, (prefix, rank) in open_ranks.items():
                    if (k[0], prefix) in part:
                        found[k] = sorted(hashes[k[0], prefix])[rank - 1]
                continue
            step = F.substring("h", 1, depth + digits).alias("next")
            counts = rows.groupBy("label", "prefix", step).agg(F.count("*").alias("n")).collect()
            children: dict[tuple[str, str], list[tuple[str, int]]] = {}
            for row in counts:
                children.setdefault((row["label"], row["prefix"]), []).append((row["next"], int(row["n"])))
            for k, v in open_ranks.items():
                if (k[0], v[0]) not in part:
                    continue
                for prefix, n in sorted(children[k[0], v[0]]):
                    if v[1] <= n:
                        v[0] = prefix
                        sizes[k[0], prefix] = n
                        break
                    v[1] -= n
    return {c: [found[c, r] if r > 0 else "" for r in rs] for c, rs in ranks.items()}


def class_sizes(df: DataFrame, label: Column, listed: int = LISTED_CLASSES) -> dict[str, int] | None:
    """Rows per class on the driver; None for more than ``listed`` classes."""
    counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).limit(listed + 1).collect()
    return None if len(counts) > listed else {r["label"]: int(r["n"]) for r in counts}


def _ranked(df: DataFrame, label: Column, hashed: Column, sizes: DataFrame, ends: Column, kind: str) -> DataFrame:
    """Rows of very many classes with ``_ends``, the last ranks of their class's parts, and ``_rank`` by hash.

    A heavy class is not ranked in one task: its ranks are found as hashes by counting, and its rows have ``_cuts``.
    """
    total = sizes.agg(F.sum("n")).first()[0]
    table = sizes.select("label", ends.cast(f"array<{kind}>").alias("_ends"), (F.col("n") * HEAVY > total).alias("_heavy"))
    heavy = {r["label"]: list(r["_ends"]) for r in table.filter("_heavy").collect()}  # fewer than HEAVY
    cuts = hash_cuts(df, label, hashed, {c: [int(r) for r in rs] for c, rs in heavy.items()}) if heavy else {}
    known = df.sparkSession.createDataFrame([(c, hs) for c, hs in cuts.items()], "_cut_class string, _cuts array<string>")
    table = table.withColumnRenamed("label", "_class").join(F.broadcast(known), F.col("_class") == F.col("_cut_class"), "left").drop("_cut_class")
    rows = df.withColumns({"_label": label, "_hash": hashed}).join(table, F.col("_label") == F.col("_class"))
    spread = F.when(F.col("_cuts").isNotNull(), F.xxhash64("_hash"))  # ranks of heavy classes are not used
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_label", spread).orderBy("_hash")))


def _without_helpers(df: DataFrame) -> DataFrame:
    return df.drop("_label", "_hash", "_class", "_ends", "_heavy", "_cuts", "_rank")


def quotas(sizes: Mapping[str, int], total: int) -> dict[str, int]:
    """Share of ``total`` per class: floors, then the largest remainders (ties by class name)."""
    rows = sum(sizes.values())
    exact = {c: n * total / rows for c, n in sizes.items()}
    result = {c: math.floor(x) for c, x in exact.items()}
    short = total - sum(result.values())
    for c in sorted(sizes, key=lambda c: (-(exact[c] - result[c]), c))[:short]:
        result[c] += 1
    return result


def can_stratify(sizes: Mapping[str, int]) -> bool:
    return len(sizes) > 1 and min(sizes.values()) >= 2


def train_rows(rows: int, train_size: float) -> int:
    """Rows on the training side: the product rounded down, safe against binary fractions."""
    return math.floor(rows * train_size + 1e-9)


def with_holdout(
    df: DataFrame, key: Sequence[str], train_size: float = 0.8, *, stratify: str | None = None, seed: int = 42,
    listed_classes: int = LISTED_CLASSES,
) -> DataFrame:
    """Add ``is_train``: exactly ``train_rows`` rows are true, per class by ``quotas`` if stratified.

    ``key`` identifies the rows. Stratification needs two or more classes of two or more rows; without them
    the split is plain.
    """
    hashed = hash_text(key, seed)
    label = F.lit("") if stratify is None else F.coalesce(as_text(df, stratify), F.lit(""))
    sizes = class_sizes(df, label, listed_classes)
    if sizes is None:
        counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
        n, least = counts.agg(F.sum("n"), F.min("n")).first()
        if least >= 2:
            return _many_classes_holdout(df, label, hashed, counts, n, train_rows(n, train_size))
        label, sizes = F.lit(""), {"": n}
    if stratify is not None and not can_stratify(sizes):
        label, sizes = F.lit(""), {"": sum(sizes.values())}
    rows = sum(sizes.values())
    share = quotas(sizes, train_rows(rows, train_size)) if rows else {}
    cuts = hash_cuts(df, label, hashed, {c: [n] for c, n in share.items()})
    return _compare(df, label, hashed, cuts, lambda h, c: h <= F.element_at(c, 1), "is_train")


def _many_classes_holdout(df: DataFrame, label: Column, hashed: Column, counts: DataFrame, rows: int, total: int) -> DataFrame:
    """The split by ``quotas`` with the class table distributed: floors, then one row more for the largest remainders."""
    exact = F.col("n") * total / rows
    shares = counts.select("label", "n", F.floor(exact).alias("base"), (exact - F.floor(exact)).alias("rest"))
    short = total - shares.agg(F.sum("base")).first()[0]
    more = shares.orderBy(F.desc("rest"), "label").limit(short).select("label", F.lit(1).alias("more"))
    sizes = shares.join(more, "label", "left")
    placed = _ranked(df, label, hashed, sizes, F.array(F.col("base") + F.coalesce("more", F.lit(0))), "bigint")
    end, cut = F.element_at("_ends", 1), F.element_at("_cuts", 1)
    chosen = F.when(F.col("_cuts").isNotNull(), F.col("_hash") <= cut).otherwise(F.col("_rank") <= end)
    return _without_helpers(placed.withColumn("is_train", chosen))


def _compare(df: DataFrame, label: Column, hashed: Column, cuts: Mapping[str, Sequence[str]], test, name: str) -> DataFrame:
    """Add ``test(hash, cuts of the class)``: literals for one class, a small broadcast for more."""
    if len(cuts) <= 1:
        ends = F.array(*[F.lit(h) for h in next(iter(cuts.values()), [""])])
        return df.withColumn(name, test(hashed, ends))
    table = df.sparkSession.createDataFrame([(c, list(hs)) for c, hs in sorted(cuts.items())], "_cut_class string, _cut_ends array<string>")
    rows = df.withColumns({"_cut_label": label, "_cut_hash": hashed})
    joined = rows.join(F.broadcast(table), F.col("_cut_label") == F.col("_cut_class"), "left")
    placed = joined.withColumn(name, test(F.col("_cut_hash"), F.col("_cut_ends")))
    return placed.drop("_cut_label", "_cut_class", "_cut_hash", "_cut_ends")


def fold_count(df: DataFrame, folds: int, target: str | None, listed: int = LISTED_CLASSES) -> tuple[int, dict[str, int] | None]:
    """(usable folds, rows per class): no more folds than rows in the smallest class, or rows at all. Of very many
    classes the rows are not listed."""
    label = F.lit("") if target is None else as_text(df.filter(~missing(df, target)), target)
    sizes = class_sizes(df if target is None else df.filter(~missing(df, target)), label, listed)
    if sizes is None:
        smallest = df.filter(~missing(df, target)).groupBy(label.alias("label")).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    else:
        smallest = min(sizes.values(), default=0)
    if target is not None and smallest < 2:
        raise ValueError(f"A class of {target!r} has a single row, which no fold can both hold out and train on.")
    if target is None and smallest < 2:
        raise ValueError(f"Folds need two rows; the table has {smallest}.")
    usable = min(folds, smallest)
    if usable < 2:
        raise ValueError(f"One fold leaves nothing to train on; got folds={folds}.")
    return usable, sizes


def with_folds(df: DataFrame, key: Sequence[str], folds: int, *, target: str | None = None, seed: int = 42,
               listed_classes: int = LISTED_CLASSES) -> DataFrame:
    """Add ``fold`` 0..k-1 (per class of ``target``, if given): k consecutive stretches of the shuffled
    rows whose sizes differ by at most one, the longer ones first."""
    usable, sizes = fold_count(df, folds, target, listed_classes)
    hashed = hash_text(key, seed)
    label = F.lit("") if target is None else F.coalesce(as_text(df, target), F.lit(""))
    if sizes is None:
        rows = df.filter(~missing(df, target))
        counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
        each, odd = F.floor(F.col("n") / usable), F.col("n") % usable
        ends = F.array(*[F.lit(i + 1) * each + F.least(F.lit(i + 1), odd) for i in range(usable - 1)])
        placed = _ranked(rows, label, hashed, counts, ends, "bigint")
        by_cut = F.size(F.filter("_cuts", lambda e: e < F.col("_hash")))
        by_rank = F.size(F.filter("_ends", lambda e: e < F.col("_rank")))
        return _without_helpers(placed.withColumn("fold", F.when(F.col("_cuts").isNotNull(), by_cut).otherwise(by_rank).cast("int")))
    ranks = {}
    for c, n in sizes.items():
        ends = [(i + 1) * (n // usable) + min(i + 1, n % usable) for i in range(usable - 1)]
        ranks[c] = ends
    cuts = hash_cuts(df, label, hashed, ranks)

    def place(h: Column, ends: Column) -> Column:
        return F.size(F.filter(ends, lambda e: e < h)).cast("int")

    return _compare(df, label, hashed, cuts, place, "fold")


def shifted_values(df: DataFrame, names: Sequence[str], key: Sequence[str], blocks: int, seed: int) -> DataFrame:
    """Add ``_moved_<i>``: each row takes the values of the next row in a random order, the last those of the
    first, within blocks drawn by the key hash. A permutation of the values that needs one shuffle and
    leaves no block larger than its even share of the rows."""
    h = hash_text(key, seed)
    rows = df.withColumns({"_h": h, "_block": F.pmod(F.xxhash64(h), F.lit(blocks))})
    order = Window.partitionBy("_block").orderBy("_h")
    cells = F.struct(*[col(c).alias(f"m{i}") for i, c in enumerate(names)])
    following = F.lead(cells).over(order)
    first = F.first(cells).over(order)
    moved = rows.withColumn("_moved", F.coalesce(following, first)).drop("_h", "_block")
    picked = {f"_moved_{i}": F.col("_moved")[f"m{i}"] for i in range(len(names))}
    return moved.withColumns(picked).drop("_moved")
