"""Exact deduplication against a persistent digest index.

The index lies at a path, bucketed and sorted by the SHA-256 of the text, and
any session that opens the path works on with it. New rows are grouped by
digest (with map-side combining), a sort-merge anti-join leaves the digests
that the index lacks, and these are appended under the name of their batch.
Verdicts are read off the index then, so a batch that is added again gets the
same ones and appends nothing twice. DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, shared_dir, written

ROW = "digest binary, keep_id long, batch string"


class DigestIndex:
    """The index at ``path`` (any file system that Spark reads), made when there is none; without a path, a new one in the shared folder.

    Columns: ``digest`` binary (32 bytes), ``keep_id`` long, ``batch`` string.
    ``<path>/spec`` says how many buckets each version has, and the last one is
    in use: a session registers it by that as a bucketed table, so that joins
    on the digest don't shuffle it. ``buckets`` counts only for a new index.
    One session may write at a time, any number may read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or shared_dir(spark)).rstrip("/")
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not self._exists(f"{self.path}/spec"):
            self._use(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._open()

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _use(self, version: int, buckets: int) -> None:
        self.spark.createDataFrame([(version, buckets)], "version int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/spec")

    def _open(self) -> None:
        spec = self.spark.read.schema("version int, buckets int").parquet(f"{self.path}/spec")
        self.version, self.buckets = spec.orderBy(F.desc("version")).first()
        self._register(self.name, self.version, self.buckets)

    def _register(self, name: str, version: int, buckets: int) -> None:
        self.spark.sql(f"drop table if exists {name}")  # of a table at a path this drops the name alone
        self.spark.sql(f"create table {name} ({ROW}) using parquet clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}/v{version}'")

    def _write(self, rows: DataFrame, name: str, buckets: int) -> None:
        rows = rows.repartition(buckets, "digest")
        rows.write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(name)

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # another session may have appended
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Removes the index and its files."""
        self.spark.sql(f"drop table if exists {self.name}")
        self._delete(self.path)

    def compact(self, buckets: int | None = None) -> None:
        """One sorted file a bucket in place of one for each append, in as many ``buckets`` as asked. The new version counts once its spec is written; the old one goes then."""
        new, old = f"{self.name}_new", self.version
        buckets = buckets or self.buckets
        self._delete(f"{self.path}/v{old + 1}")  # of a compaction that didn't end
        self._register(new, old + 1, buckets)
        self._write(self.table(), new, buckets)
        self.spark.sql(f"drop table {new}")
        self._use(old + 1, buckets)
        self._open()
        self._delete(f"{self.path}/v{old}")

    def add(self, rows: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
        """Judges ``rows`` and appends the digests that were new, as ``batch``.

        Returns one row per input row: ``<id_col>``, ``keep_id`` (row that
        stays), ``group_size`` (equal rows in this batch), ``kept``,
        ``digest``, and ``key_col`` where it is given. Of equal texts the row
        with the largest id stays; a text that another batch has brought stays
        with the row indexed first. Null text is the empty text. Rows with a
        null id are judged too and stay only where no row of the group has an
        id. Rows that repeat an id with the same text are each returned and
        marked alike, but where ``key_col`` (a number that no two rows share)
        tells them apart: then the one of the largest key stays alone. Extra
        columns are ignored. An empty table gives an empty result.

        Adding a batch of the same rows and name again gives the same result
        and leaves the index as it was, so a job that failed after its append
        can be run again. Digests of many rows meet their verdict by a
        broadcast of fewer than 100,000 of them, the others by a sort-merge
        join.
        """
        key = F.col(key_col).cast("long") if key_col else F.lit(None).cast("long")
        digests = written(rows.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")))
        groups = written(digests.groupBy("digest").agg(F.max(F.struct("id", "key")).alias("keep"), F.count(F.lit(1)).alias("group_size")))
        new = groups.hint("merge").join(self.table(), "digest", "left_anti")
        self._write(new.select("digest", F.col("keep.id").alias("keep_id"), F.lit(batch).alias("batch")), self.name, self.buckets)
        known = self.table().select("digest", "keep_id", (F.col("batch") != batch).alias("before"))
        judged = written(groups.hint("merge").join(known, "digest"))
        out = by_key(digests, judged, ["digest"], "group_size")
        stays = ~F.col("before") & F.col("id").eqNullSafe(F.col("keep.id")) & F.col("key").eqNullSafe(F.col("keep.key"))
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), "digest", *([F.col("key").alias(key_col)] if key_col else []))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = DigestIndex(spark)
    out = index.add(docs, "documents").select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    index.drop()  # the verdicts are written; this query's index serves no later batch
    return out


OP4_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, digest as text_sha256
from (select doc_id, sha256(coalesce(text, '')) as digest from documents)
window w as (partition by digest)
"""
