"""Exact deduplication against a persistent digest index.

The index is a parquet table bucketed and sorted by digest.  A batch is reduced to one row
per digest, staged in the same buckets, compared with the index by a sort-merge anti-join
that moves no row of the index, and what is new is appended.  Offering a batch again changes
nothing, so a job that died between append and report can simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm.common import looked_up, saved, table_name
from tapewire.sources.sinks import work_dir

COLUMNS = "digest BINARY, keep_id BIGINT"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``digest`` of every row."""
    return df.select(F.col(id_col).cast("bigint").alias("_id"), digest(F.col(text_col)).alias("digest"))


class DigestIndex:
    """The digests seen so far, each with the id that holds it.

    ``buckets`` counts only when the index is made; choose it for the size the index will
    reach (about 128 MB, three million digests, a bucket).  An index found at ``path`` is opened.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = table_name("digest_index", path)
        self._make(self.name, COLUMNS, path)

    def _make(self, name: str, columns: str, path: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _append(self, df: DataFrame, name: str) -> None:
        df.repartition(self.buckets, "digest").write.insertInto(name)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def offer(self, prints: DataFrame) -> DataFrame:
        """Adds the new digests of ``prints`` (see `fingerprints`).

        Returns one row per digest of the batch: ``digest``, ``keep_id`` (the id that the index
        holds for it; of new ones the smallest of the batch), ``group_size`` (rows of the batch).
        Rows without an id take no part.
        """
        groups = prints.where(F.col("_id").isNotNull()).groupBy("digest")
        staged = work_dir(self.spark, "digest_batch")
        batch = table_name("digest_batch", staged)
        self._make(batch, f"{COLUMNS}, group_size BIGINT", staged)
        self._append(groups.agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), batch)
        fresh = self.spark.table(batch).join(self.rows().hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", "keep_id"), self.name)
        sizes = self.spark.table(batch).select("digest", "group_size")
        return self.rows().hint("merge").join(sizes, "digest")

    def compact(self, path: str) -> DigestIndex:
        """A new index with the same rows and one sorted file a bucket."""
        target = DigestIndex(self.spark, path, self.buckets)
        target._append(self.rows(), target.name)
        return target


def deduplicate(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A decision for every row of ``df``; what is new goes into ``index``.

    Columns: the id, ``keep_id``, ``group_size`` (rows of this batch with the text), ``kept``,
    ``text_sha256``.  Null text counts as empty, and empty texts are equal to each other.  Rows
    that repeat id and text are all kept or all dropped.  A row without an id is kept, with null
    ``keep_id`` and ``group_size``: it cannot be named as the row that stays.  Other columns are
    ignored, whatever their names.
    """
    return _decided(df, index, id_col, text_col)[0]


def _decided(df: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """`deduplicate`, and how many rows there are."""
    prints = saved(fingerprints(df, id_col, text_col), "fingerprints")
    n = prints.count()
    known = saved(index.offer(prints), "digest_groups", n)
    mine = F.when(F.col("_id").isNotNull(), F.col("digest"))
    found = looked_up(prints.withColumn("_key", mine), "_key", known.withColumnRenamed("digest", "_key"), "group_size", ["keep_id", "group_size"])
    found = found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return found, n


def keep_first(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of rows that repeat id and text, one.

    Rows are told apart by id and text: one id may hold several texts, each decided on its own.
    """
    decisions, n = _decided(df, index, id_col, text_col)
    decisions = saved(decisions, "decisions", n)
    mine = df.withColumns({"_mine": F.col(id_col).cast("bigint"), "_sha": F.lower(F.hex(digest(F.col(text_col))))})
    of = (F.col("_mine") == F.col("_of")) & (F.col("_sha") == F.col("_text"))
    named = (F.col(id_col).alias("_of"), F.col("text_sha256").alias("_text"))
    dropped = decisions.where(~F.col("kept")).select(*named)
    stays = mine.join(dropped.hint("shuffle_hash"), of, "left_anti")
    again = decisions.where("kept and keep_id is not null").groupBy(*named).count().where("count > 1")
    again = saved(again.select("_of", "_text"), "repeated_rows")
    if not again.isEmpty():
        single = stays.join(again, of, "left_anti")
        stays = single.unionByName(stays.join(again, of, "left_semi").dropDuplicates(["_mine", "_sha"]))
    return stays.drop("_mine", "_sha")
