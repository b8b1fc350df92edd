"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest, one row per distinct text.
New documents are reduced to one row per digest before they meet the index, so a
text that fills a third of the input is a single row there; a sort-merge
anti-join finds the digests that are new, and these are appended. Digests that an
earlier batch brought go to a second table of the same shape, so that sizes and
the best row of each text can be told over all batches.

Texts are equal when identical after deleting every ASCII white space character.
Of equal texts, the row with the most code points in its original text stays,
then the smallest id. ``dedupe`` takes batches as they come: a text that an
earlier batch brought keeps that batch's row. ``standing`` looks at all batches.

Edge cases: a null text is an empty one. A null id is larger than any other.
Rows repeated with the same id and text have one winner among them in ``kept``
only by id: every repeated row of the winning id says kept, and ``dedupe`` keeps
one of them. Extra columns are ignored by ``digests`` and kept by ``dedupe``. An
empty table gives an empty result and appends nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, bounded_broadcast, staged


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without its ASCII white space; null counts as empty."""
    bare = reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), ASCII_SPACE, F.coalesce(text.cast("string"), F.lit("")))
    return F.sha2(bare.cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``chars`` (code points), ``digest`` of each row."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), text_digest(text).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id, chars, n, batch), bucketed and sorted by digest, and one like it for digests met again.

    Both are tables of the session's catalogue, in its warehouse. To outlive the
    session they need a persistent catalogue, and on a cluster a shared warehouse, which
    must be named: the default one is a folder of each machine's own.
    Batch names are given once; a batch run again after a failure appends nothing twice.
    """

    COLUMNS = "digest string, keep_id long, chars int, n long, batch string"

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.again, self.buckets = spark, table, f"{table}_again", buckets

    def _append(self, rows: DataFrame, table: str) -> None:
        # one file a bucket and batch, not one a bucket and task
        rows = rows.select("digest", "keep_id", "chars", "n", "batch").repartition(self.buckets, "digest")
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    def create(self) -> None:
        """Empty tables, unless they are there; a table that ``compact`` was about to replace is put back."""
        context = self.spark.sparkContext
        if context.master.partition("[")[0] != "local" and not context.getConf().contains("spark.sql.warehouse.dir"):
            raise ValueError("spark.sql.warehouse.dir must name a folder that the driver and all executors share")
        for table in (self.table, self.again):
            if not self.spark.catalog.tableExists(table) and self.spark.catalog.tableExists(f"{table}_old"):
                self.spark.sql(f"ALTER TABLE {table}_old RENAME TO {table}")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Send ``rows`` (as ``digests`` gives them) through the anti-join with the index and append what is new.

        Returns ``digest``, ``keep_id``, ``chars``, ``n`` of the batch: one row for each
        distinct text, so a text that fills a third of the batch meets the index once.
        """
        self.create()
        # a larger id has a smaller complement, and no id overflows
        best = F.struct(F.col("chars"), F.bitwise_not("doc_id").alias("by"))
        groups = rows.groupBy("digest").agg(F.max_by("doc_id", best).alias("keep_id"), F.max("chars").alias("chars"), F.count("*").alias("n"))
        groups = staged(groups.withColumn("batch", F.lit(batch)), "digest-groups")
        known = self.spark.table(self.table).select("digest", F.col("batch").alias("of"))
        self._append(groups.join(known.hint("merge"), "digest", "left_anti"), self.table)
        seen = self.spark.table(self.again).where(F.col("batch") == batch).select("digest")
        more = groups.join(known.where(F.col("of") != batch).hint("merge"), "digest", "left_semi")
        self._append(more.join(seen.hint("merge"), "digest", "left_anti"), self.again)
        return groups

    def first(self) -> DataFrame:
        """``digest``, ``keep_id``, ``batch``: the row that brought each text."""
        return self.spark.table(self.table).select("digest", "keep_id", "batch")

    def standing(self) -> DataFrame:
        """``digest``, ``keep_id``, ``group_size``: the best row of each text over all batches, and how many there were."""
        rank = lambda keep, chars: F.struct(F.col(chars), F.bitwise_not(keep).alias("by"))
        more = self.spark.table(self.again).groupBy("digest").agg(
            F.max_by("keep_id", rank("keep_id", "chars")).alias("keep_more"), F.max("chars").alias("chars_more"), F.sum("n").alias("n_more")
        )
        # both are bucketed by digest, so nothing is shuffled
        both = self.spark.table(self.table).join(more.hint("merge"), "digest", "left")
        later = F.col("n_more").isNotNull() & (rank("keep_more", "chars_more") > rank("keep_id", "chars"))
        return both.select("digest", F.when(later, F.col("keep_more")).otherwise(F.col("keep_id")).alias("keep_id"), (F.col("n") + F.coalesce("n_more", F.lit(0))).alias("group_size"))

    def compact(self) -> None:
        """Write both tables anew, one sorted file a bucket; every batch has added its own.

        The new table is whole before the old one steps aside, and the old one goes last: a crash in between loses nothing.
        """
        self.create()
        for table in (self.table, self.again):
            fresh = f"{table}_{uuid.uuid4().hex}"
            # the files themselves: a bucketed scan would pass for sorted out already
            files = self.spark.table(table).inputFiles()
            rows = self.spark.read.schema(self.COLUMNS).parquet(*files) if files else self.spark.createDataFrame([], self.COLUMNS)
            self._append(rows, fresh)
            self.spark.sql(f"DROP TABLE IF EXISTS {table}_old")
            self.spark.sql(f"ALTER TABLE {table} RENAME TO {table}_old")
            self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
            self.spark.sql(f"DROP TABLE {table}_old")

    def drop(self) -> None:
        for table in (self.table, self.again):
            for name in (table, f"{table}_old"):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def new_table_name(prefix: str = "exact_dedup_index") -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def members(rows: DataFrame, standing: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``keep_id``, ``group_size``, ``kept`` of each of ``rows``.

    A hot digest is split by adaptive execution: plain rows on the left, one row a digest of a written table on the right.
    """
    return rows.join(staged(standing, "digest-standing"), "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def dedupe(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is new to ``index``, one for each text.

    Texts don't travel where the rows to drop are few enough to be broadcast; else they meet in one merge join.
    """
    narrow = staged(digests(docs, id_col, text_col), "digests")
    # one row a digest meets the bucketed index, so that a digest with many rows only meets a plain table, which splits it
    groups = index.add(narrow, batch).select("digest")
    winners = staged(groups.join(index.first().hint("merge"), "digest"), "digest-winners")
    same = narrow.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
    told = same.join(winners, "digest").select(F.col("digest").alias("__of"), F.col("doc_id").alias("__who"), stays.alias("__stays"), "copies")
    told = staged(told.where(~F.col("__stays") | (F.col("copies") > 1)), "digest-told")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__id"), text_digest(F.col(text_col)).alias("__digest"))
    met = rows.join(bounded_broadcast(told), (F.col("__digest") == F.col("__of")) & F.col("__id").eqNullSafe(F.col("__who")), "left")
    # only rows that repeat an id with its text are still more than one
    once = met.where("__stays").dropDuplicates(["__digest", "__id"])
    return met.where("__stays IS NULL").unionByName(once).select("__row.*")
