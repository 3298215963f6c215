import os
import random

from logveil.sources import tail
from logveil.sources.tail import Log, LogTail, _Tail


def drained(spark, folder, **options):
    spark.dataSource.register(LogTail)
    stream = spark.readStream.format("log_tail").option("path", f"{folder}/app.log")
    for k, v in options.items():
        stream = stream.option(k, v)
    query = stream.load().writeStream.format("parquet").option("path", f"{folder}.out").option("checkpointLocation", f"{folder}.checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive
    return sorted(r.value for r in spark.read.schema("value string").parquet(f"{folder}.out").collect())


def test_rotated_and_cut_files_lose_and_double_nothing(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log, written = folder / "app.log", []

    def write(n, path=log, end="\n"):
        with open(path, "ab") as f:
            for _ in range(n):
                written.append(f"line {len(written)} é")
                f.write((written[-1] + end).encode())

    assert drained(spark, str(folder)) == []
    write(50)
    with open(log, "ab") as f:
        f.write(b"half a ")
    assert drained(spark, str(folder), bytesPerPartition="64") == sorted(written)
    with open(log, "ab") as f:
        f.write(b"line\n\n")
    written.append("half a line")
    log.rename(folder / "app.log.1")  # renamed with lines that weren't read
    write(30)
    assert drained(spark, str(folder), bytesPerPartition="64") == sorted(written)
    write(5)
    os.link(log, folder / "copy")  # copied, and cut under its name
    (folder / "copy").rename(folder / "app.log.2")
    log.unlink()
    write(20, end="\r\n")
    (folder / "other.log").write_text("not of this log\n")
    assert drained(spark, str(folder)) == sorted(written)
    assert drained(spark, str(folder)) == sorted(written)


def test_ranges_of_any_size_give_every_line_once(tmp_path):
    rng = random.Random(1)
    lines = ["x" * rng.randrange(1, 40) + str(k) for k in range(200)]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\nopen")
    for size in (1, 7, 50, 10_000):
        reader = _Tail(Log(f"{tmp_path}/app.log"), size, None)
        start, end = reader.initialOffset(), reader.latestOffset()
        got = [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert got == lines


def test_a_batch_takes_in_what_it_may(tmp_path):
    for name in ("app.log", "app.log.1"):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(100)))
    reader = _Tail(Log(f"file://{tmp_path}/app.log"), 1 << 20, 300)
    start, got, batches = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != start:
        batches += 1
        got += [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert sum(end.values()) - sum(start.values()) <= 300 + 20
        start = end
    assert sorted(got) == sorted(f"{n} {k}" for n in ("app.log", "app.log.1") for k in range(100)) and batches >= 8


def test_long_lines_and_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 16)
    lines = ["a" * 5000, "b", "c" * 100, ""]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\nd")
    reader = _Tail(Log(f"{tmp_path}/app.log"), 33, None)
    got = [v for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert got == lines[:3]
