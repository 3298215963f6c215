"""The ledger as a stream: running sums of an appended log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import audit


def running_buckets(entries: DataFrame) -> DataFrame:
    """Sums by provider, model and month of a stream of entries; use output mode ``complete`` or ``update``."""
    return ledger.buckets(entries)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """A stream of entries from files that arrive in a folder."""
    return audit.parse(spark.readStream.text(path))


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """A stream of entries from one file that grows."""
    spark.dataSource.register(audit.AppendedLines)
    return audit.parse(spark.readStream.format("appended").option("path", path).load().select("value"))


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now, into Parquet under ``folder``, where its checkpoint is too.

    ``append``: the file sink, which writes each row once whatever fails.
    ``complete``: each batch's table takes the place of the one before, in a
    folder of its own.
    """
    spark, out = stream.sparkSession, f"{folder}/table"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    last = [f"{out}/none"]
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(last[0])

    def put(table: DataFrame, batch: int) -> None:
        last[0] = f"{out}/batch={batch}"
        table.write.mode("overwrite").parquet(last[0])

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0])


def by_minute(entries: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests in windows of a minute, late ones up to ``late`` counted."""
    at = entries.withColumn("at", F.try_to_timestamp("time")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 minute"), "provider").agg(F.count(F.lit(1)).alias("requests")).select(F.col("window.start").alias("minute"), "provider", "requests")
