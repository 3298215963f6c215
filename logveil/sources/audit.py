"""The request log: JSON lines, appended."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.ledger import AUDIT


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries; lines that aren't JSON objects are left out."""
    return parse(spark.read.text(path))


def parse(lines: DataFrame) -> DataFrame:
    entry = F.from_json("value", AUDIT, {"mode": "PERMISSIVE"})
    return lines.where(F.trim("value").startswith("{") & F.trim("value").endswith("}")).select(entry.alias("e")).where("e is not null").select("e.*")


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


class AppendedLines(DataSource):
    """``readStream.format("appended").option("path", file)``: complete lines appended to one file, by byte offset.

    A line without its end is left for the next batch; a file that has shrunk
    is read from its start.
    """

    @classmethod
    def name(cls) -> str:
        return "appended"

    def schema(self) -> str:
        return "value string, at long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Appended(self.options["path"])


class _Appended(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = Path(path)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _lines(self, low: int, high: int | None):
        size = self.path.stat().st_size if self.path.exists() else 0
        low = 0 if size < low else low
        with self.path.open("rb") as f:
            f.seek(low)
            block = f.read() if high is None else f.read(high - low)
        whole = block[: block.rfind(b"\n") + 1]
        rows, at = [], low
        for line in whole.split(b"\n")[:-1]:
            if line.strip():
                rows.append((line.decode("utf-8", "replace").rstrip("\r"), at))
            at += len(line) + 1
        return rows, low + len(whole)

    def read(self, start: dict):
        if not self.path.exists():
            return iter(()), start
        rows, end = self._lines(start["at"], None)
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._lines(start["at"], end["at"])[0])
