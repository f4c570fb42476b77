"""Exact de-duplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. A batch is reduced to one
row per digest before anything is shuffled by digest alone, new digests are found
by a sort-merge anti-join that reads the index without moving it, and are then
appended. A batch has a name: adding it again under its name adds nothing and gives
the same decisions, so a failed run can be repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, keyed, stage

#: A text that more than this share of a batch carries is joined by broadcast; fewer than 1 / HOT_SHARE texts can.
HOT_SHARE = 0.001


class DigestIndex:
    """An append-only table (digest, keep_id, batch).

    ``buckets`` is fixed when the table is made and should fit its final size;
    by default it is the number of shuffle partitions, so that a batch grouped by
    digest needs no second shuffle to meet the index.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], "digest binary, keep_id long, batch string"))

    def _append(self, rows: DataFrame) -> None:
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """De-duplicate a batch against the index and itself, append what is new, return the decisions.

        One row per distinct (doc_id, text): doc_id, keep_id, group_size (rows of
        this batch with the text), kept, text_sha256, known (the text was in the
        index before), n_rows (how often the row is repeated). Of equal texts the
        largest doc_id stays, or the one that the index already holds. Null text
        counts as empty; null ids lose against every other id; an empty batch
        gives no rows. What ``batch`` itself has put into the index before, in a run
        that failed or is repeated, isn't known; without a name each call is a batch
        of its own.
        """
        batch = batch or uuid.uuid4().hex
        digests = documents_of(docs).select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
        rows = stage(digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n_rows")), "digests")
        # Written, or the anti-join would be moved below the sum and meet all rows of a digest in one task.
        groups = stage(rows.groupBy("digest").agg(F.max("doc_id").alias("largest"), F.sum("n_rows").alias("group_size")), "sums")
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", F.col("largest").alias("keep_id"), F.lit(batch).alias("batch")).repartition(self.buckets, "digest"))
        known = F.col("batch") != batch
        resolved = groups.join(self.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size", known.alias("known"))
        resolved = stage(resolved, "groups")
        total = resolved.agg(F.sum("group_size")).first()[0] or 0
        hot = F.col("group_size") > total * HOT_SHARE + 1
        found = rows.join(F.broadcast(resolved.where(hot)), "digest")
        cold = rows.join(F.broadcast(resolved.where(hot).select("digest")), "digest", "left_anti")
        found = found.unionByName(cold.join(resolved.where(~hot), "digest"))
        return found.select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "known",
            "n_rows",
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``DigestIndex.add`` of one batch to a new index, which is dropped afterwards."""
    index = DigestIndex(docs.sparkSession, f"terrazzo_digests_{uuid.uuid4().hex}")
    try:
        return stage(index.add(docs), "decisions")
    finally:
        index.drop()


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no other row with a larger doc_id has; all columns stay.

    Null text counts as empty; null ids lose against every other id. Of rows that repeat
    doc_id and text one stays, whichever. An empty table gives no rows.
    """
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest"), "n_rows")
    own = keyed(docs, id=docs["doc_id"].cast("long"), digest=F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)))
    found = own.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    out = found.where("n_rows = 1").select("row.*")
    if not kept.where("n_rows > 1").isEmpty():
        out = out.unionByName(found.where("n_rows > 1").dropDuplicates(["id", "digest"]).select("row.*"))
    return out
