"""Documents to training data: quality, exact and near copies, benchmark leaks, token ids.

Each stage gets the documents that the one before kept, and the folder of the
tables for what else it needs. All but the last return the columns they got.
Quality is judged within the row; the other stages decide by a number of the
row (its file and its place there, as each stage reads what the one before has
written), so that rows without an id, and rows that share one, are each judged
by their own text. A stage begins with removing what the stages before have
left in the shared folder and its rows don't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.llm import byte_bpe, decontaminate, line_quality, near_dedup
from logveil.llm.common import bucket, cleared, numbered, table, tracked, written
from logveil.llm.exact_dedup import DigestIndex

ROW, SCORE = "row of the stage", "score of the stage"
SENT = 1_000_000  # row numbers that may be broadcast


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field calls good; it learns from the labels of rows outside the held-out quarter.

    It learns from the texts of ``documents``, so that what it learns doesn't
    depend on what an earlier stage has dropped. Null and empty texts are one
    empty line and are judged like others; repeated rows are judged alike; a
    score of the threshold itself is good; without labels every score is 0.5,
    and every document goes.
    """
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 4) != 2)
    model = line_quality.fit(table(spark, sf_dir, "documents"), labels)
    return line_quality.with_score(docs, model, SCORE).where(F.col(SCORE) >= line_quality.THRESHOLD).drop(SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one of the largest id.

    Null and empty texts are equal. A row without an id stays only where no
    row of its group has one; of rows that repeat id and text one stays.
    """
    rows, index = numbered(docs, ROW), DigestIndex(spark)
    kept = written(index.add(rows, "pipeline", key_col=ROW).where("kept").select(ROW))
    index.drop()
    return _keep(rows, kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, the one of the smallest id; rows without an id stay last.

    Null, empty and blank texts link with nothing, so each of them stays.
    """
    rows = numbered(docs, ROW)
    return _keep(rows, near_dedup.near_duplicates(rows, percent=80, key_col=ROW).where("stays"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text doesn't hold half of a benchmark item; null and empty texts hold none, an empty benchmark keeps all."""
    rows = numbered(docs, ROW)
    return _keep(rows, decontaminate.verdicts(rows, table(spark, sf_dir, "benchmark"), key_col=ROW).where("not contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of the byte-level BPE for every row; null and empty texts have no ids."""
    import public_tokenizers

    # workers still hold what earlier stages needed, so this one keeps less
    coded = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), offsets=False, cache=250_000)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def _keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The ``rows`` whose number is in ``kept``; a side of checked size is broadcast, a larger one joined by sorting.

    The numbers that go are mostly the shorter list, so it is they that are sent.
    """
    gone = written(rows.select(ROW).join(kept.select(ROW), ROW, "left_anti"))
    side = F.broadcast(gone) if gone.count() <= SENT else gone
    return rows.join(side, ROW, "left_anti").drop(ROW)


def _stage(work: Callable) -> Callable:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        cleared(docs)
        with tracked():
            return work(spark, docs, sf_dir)

    return run


STAGES = [(name, _stage(work)) for name, work in (("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", leaks), ("tokens", tokens))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with tracked():
                docs = written(docs)
    return docs


#: The quality field, MinHash components, tilings and BPE have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None
