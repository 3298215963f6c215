import random
import time

from pyspark.sql import functions as F

from logveil.operators.kernel import MaskConfig, Session
from logveil.streaming import vaults

ROWS = "vault string, incident_id string, ord long, text string"


def made(n, seed=3):
    rng = random.Random(seed)
    parts = ["user=u{}", "u{}", "host=srv-{}.lan", "srv-{}", "10.0.0.{}", "u{}@corp.io", "DOM{}\\u{}", "password=p{}!", "p{}!", "token: **", "**"]
    return [(f"v{k % 3}", f"i{k}", k, " ".join(rng.choice(parts).replace("{}", str(rng.randrange(6))) for _ in range(rng.randrange(9)))) for k in range(n)]


def drained(spark, folder, config=None, **how):
    """One run over what the folder has that the checkpoint hasn't seen; the query ends, and with it all that it held in memory."""
    stream = spark.readStream.schema(ROWS).parquet(f"{folder}/in")
    query = vaults.masked(stream, config, **how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(600)
    assert not query.isActive and query.exception() is None


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = made(60)
    config = MaskConfig(base_mapping={"[USER_9]": "u5"}, base_counters={"IP": 4})
    want = {}
    for v in ("v0", "v1", "v2"):
        session = Session(config)
        want |= {r[1]: (session.mask(r[3])[0], len(session.learned)) for r in rows if r[0] == v}
    for part in (rows[:35], rows[35:]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drained(spark, tmp_path, config)
    got = {r.incident_id: (r.masked, r.n_values) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_late_incidents_are_marked(spark, tmp_path):
    for part in ([("v", "a", 5, "user=jdoe"), ("v", "b", 4, None)], [("v", "c", 3, "jdoe user=mia"), (None, "d", None, "user=jdoe")]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drained(spark, tmp_path)
    got = {(r.vault, r.incident_id, r.masked, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("v", "b", "", False), ("v", "a", "user=[USER_1]", False), ("v", "c", "[USER_1] user=[USER_2]", True), ("", "d", "user=[USER_1]", False)}


def test_a_stream_with_an_idle_time_runs_until_it_is_stopped(spark, tmp_path):
    spark.createDataFrame([("v", "a", 1, "user=jdoe"), ("v", "b", 2, "jdoe")], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = vaults.masked(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), idle_ms=3_600_000)
    query = stream.writeStream.format("memory").queryName("vault_rows").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 120
        while time.monotonic() < until and spark.table("vault_rows").count() < 2:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(r.masked for r in spark.table("vault_rows").collect()) == ["[USER_1]", "user=[USER_1]"]


def test_batch_and_stream_agree(spark, tmp_path):
    from logveil.operators import vaulting

    rows = [("all", i, k, t) for _, i, k, t in made(40, 8)]
    for part in (rows[:11], rows[11:]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drained(spark, tmp_path)
    stream = {(r.incident_id, r.masked) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r.incident_id, r.masked) for r in vaulting.vaulted(spark.createDataFrame(rows, ROWS).withColumn("clash", F.lit(1))).collect()}
    assert stream == batch
