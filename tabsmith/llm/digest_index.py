"""Exact dedup over a persistent index of digests, bucketed and sorted by digest.

Two texts are equal when they are identical after each run of ASCII white space is replaced by one space. A null
text is empty. The index holds one row per distinct text: its SHA-256 and the id of the row that stays. New rows are
first reduced to one row per digest, so that copies never meet in one task; a sort-merge anti-join with the index,
which needs no shuffle on the index's side, finds the new digests, and those are appended in the same buckets.

Edge cases: an empty table changes nothing. The smallest id of a group stays; null ids come last, so a group keeps a
null id only if it has no other. A row that repeats both id and text is a copy like any other: one of them stays.
Columns beside ``doc_id`` and ``text`` are not read, whatever their names. A text indexed by an earlier batch stays
the one that is kept, also against smaller ids in a later batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import bounded, stored, text_or_empty

SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACES, " ")


def digest(name: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(name).cast("binary"), 256))


class DigestIndex:
    """Digests of all texts seen so far, in the folder ``location``, which outlives the session."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 32) -> None:
        self.spark, self.location, self.buckets = spark, location, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> DataFrame:
        """Index the digests of ``batch(doc_id, digest)`` that are new and return them as (digest, keep_id).

        Repeating a batch whose append was lost or committed does no harm: what is there is not new again.
        """
        groups = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh = stored(new, "digests-new")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        return fresh

    def kept(self, batch: DataFrame) -> DataFrame:
        """``batch(doc_id, digest)`` with ``keep_id``, ``group_size`` (rows of the batch) and ``kept``, a row each."""
        sizes = batch.groupBy("digest").agg(F.count("*").alias("group_size"))
        groups = stored(sizes.join(self.rows().hint("merge"), "digest"), "digest-groups")
        once = batch.groupBy("digest", "doc_id").agg(F.count("*").alias("__times"))
        each = once.select("digest", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "__times")).alias("__time"))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__time") == 1)
        return each.join(groups, "digest").withColumn("kept", kept).drop("__time")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of each row, stored: the texts are read once."""
    return stored(docs.select("doc_id", digest().alias("digest")), "digests")


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` whose text is neither in the index nor in a row with a smaller id. Indexes them.

    Only rows that repeat both id and text are shuffled with their texts, or all if the dropped ids are many.
    """
    batch = digests(docs)
    fresh = index.add(batch).select("digest", F.col("keep_id").alias("__keep"), F.lit(True).alias("__new"))
    once = batch.groupBy("digest", "doc_id").agg(F.count("*").alias("__times"))
    stays = F.coalesce(F.col("__new") & F.col("doc_id").eqNullSafe(F.col("__keep")), F.lit(False))
    odd = once.join(fresh, "digest", "left").select(
        F.col("digest").alias("__digest"), F.col("doc_id").alias("__id"), stays.alias("__stays"), "__times"
    )
    odd = stored(odd.where(~F.col("__stays") | (F.col("__times") > 1)), "digests-odd")
    marked = docs.withColumn("__digest_of", digest())
    side = F.broadcast(odd) if bounded(odd) else odd.hint("merge")
    matches = (F.col("__digest_of") == F.col("__digest")) & marked["doc_id"].eqNullSafe(F.col("__id"))
    joined = marked.join(side, matches, "left")
    single = joined.where(F.col("__digest").isNull())
    repeated = joined.where(F.col("__stays")).dropDuplicates(["__digest_of"])
    return single.unionByName(repeated).drop("__digest_of", "__digest", "__id", "__stays", "__times")
