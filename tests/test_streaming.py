import datetime as dt
import os
import random
import statistics
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_containers import chunk, jpeg, png, seg

from mediasieve.jobs import reports
from mediasieve.jobs.queries import QUERIES
from mediasieve.sources import media as M
from mediasieve.streaming import files as S


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()


def test_arrivals_give_what_the_batch_gives(spark, tmp_path):
    for name, data in (("a.png", png()), ("b.jpg", jpeg(seg(0xFE, b"c2pa manifest"))), ("c.png", png(chunk(b"tEXt", b"prompt\0x")))):
        (tmp_path / name).write_bytes(data)
    drain(S.inspect_arrivals(spark, str(tmp_path), max_files=1).select("path", "verdict"), "arrivals")
    got = {r.path.rsplit("/", 1)[1]: r.verdict for r in spark.table("arrivals").collect()}
    batch = reports.audit(M.scan(spark, str(tmp_path)).select("path", "rel_path", "content"))
    assert got == {r.path.rsplit("/", 1)[1]: r.verdict for r in batch.collect()}
    assert got["c.png"] == "ai-declared"


def test_progress_stream(spark, tmp_path):
    rows = [(1, 1.0, "a", False), (1, 2.0, "b", True), (2, 1.0, "c", False)]
    spark.createDataFrame(rows, "run_id long, ts double, name string, failed boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, ts double, name string, failed boolean").parquet(str(tmp_path / "in"))
    drain(S.progress(stream), "progress", "update")
    assert {tuple(r) for r in spark.table("progress").collect()} == {(1, 2, 1, "b"), (2, 1, 0, "c")}


def test_expired_jobs(spark):
    jobs = spark.createDataFrame([(1, 0.0, 9000.0), (2, 5000.0, 9000.0), (3, 9000.0, 0.0), (4, 9000.0, None)], "job_id long, created double, mtime double")
    assert sorted(r.job_id for r in S.expired(jobs, 10000.0).collect()) == [1, 3, 4]


@pytest.mark.parametrize("shift", ["0 days", "400 days", "-20000 days"])
def test_jobs_are_judged_at_the_middle_of_their_times(spark, tmp_path, shift):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.when(F.col("event_id") % 37 != 0, F.expr(f"ts + INTERVAL {shift}")))
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = [(r.event_id, r.ts and (r.ts - dt.datetime(1970, 1, 1)) / dt.timedelta(seconds=1), r.value) for r in events.collect()]
    now = statistics.median(t for _, t, _ in rows if t is not None)
    want = [k for k, t, value in rows if k % 31 == 0 or t is None or max(now - t, now - (t + value * 60)) > 7200]
    assert sorted(r.job_id for r in QUERIES["expired_jobs"](spark, str(tmp_path)).collect()) == sorted(want)


def test_jobs_without_times(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    for name, found in (("none", events.where("false")), ("untimed", events)):
        found.write.parquet(str(tmp_path / name / "events.parquet"))
    assert QUERIES["expired_jobs"](spark, str(tmp_path / "none")).count() == 0
    assert QUERIES["expired_jobs"](spark, str(tmp_path / "untimed")).count() == 3  # no folder is known of any


def test_middle(spark):
    draw = random.Random(5)
    cases = [[3.0], [1.0, 2.0], [2.0, 2.0, 2.0], [0.0] * 50 + [1e12] * 50, [0.0] * 51 + [1e12] * 50, [-1e12, *(1.7e9 + k / 1e6 for k in range(200)), 1e15]]
    cases += [[draw.choice([draw.uniform(-9, 9), float(draw.randrange(4)), 1.7e9 + draw.randrange(10**12) / 1e6]) for _ in range(n)] for n in (99, 100, 1001)]
    for values in cases:
        draw.shuffle(values)
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert {S.middle(rows, "v", bins) for bins in (3, 4096)} == {statistics.median(values)}
    assert S.middle(rows.where("v IS NULL"), "v") is None


def test_expiry_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for k, (job, hours) in enumerate([(1, 0), (2, 1), (3, 5), (4, 9)]):
        spark.createDataFrame([(job, start + dt.timedelta(hours=hours))], "job_id long, created timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    whole = spark.read.parquet(*(str(tmp_path / f"in{k}") for k in range(4))).repartition(1)
    whole.where("job_id < 4").write.parquet(str(tmp_path / "all" / "d=1"))
    stream = spark.readStream.schema("job_id long, created timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    drain(S.expire_stream(stream.withColumn("created", F.col("created"))), "expiry")
    assert {r.job_id for r in spark.table("expiry").collect()} <= {1, 2}


def test_jobs_expire_by_the_older_of_two_times(spark, tmp_path):
    """Jobs that are old when they are first seen, that change later, and whose folder goes; late ones within the delay count."""
    day = dt.datetime(2024, 1, 1)
    at = lambda h, m=0: day + dt.timedelta(hours=h, minutes=m)
    batches = [
        [(1, at(9), at(9), at(10)), (2, at(10), at(10), at(10))],
        [(3, at(10, 5), at(8), at(10, 10)), (2, at(10), at(10, 10), at(10, 10))],
        [(4, at(10, 20), None, at(10, 20)), (5, at(10, 15), at(10, 15), at(10, 16))],
        [(6, at(12), at(12), at(12))],
        [(7, at(13), at(13), at(13, 5))],
        [(7, at(13), at(13), at(13, 6))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "job_id long, created timestamp, mtime timestamp, seen timestamp").coalesce(1).write.parquet(str(tmp_path / f"d={k}"))
        for f in (tmp_path / f"d={k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("job_id long, created timestamp, mtime timestamp, seen timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    drain(S.expire_stream(stream, delay="10 minutes"), "expiry2")
    # The watermark ends at 12:56.
    assert sorted(r.job_id for r in spark.table("expiry2").collect()) == [1, 2, 3, 4, 5]


def test_a_job_expires_by_the_wall_clock_without_later_events(spark, tmp_path):
    now = dt.datetime.now(dt.timezone.utc)
    rows = [(1, now), (2, now + dt.timedelta(hours=1))]
    spark.createDataFrame(rows, "job_id long, created timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("job_id long, created timestamp").parquet(str(tmp_path / "in"))
    query = S.expire_stream(stream, seconds=5, clock="processing").writeStream.format("memory").queryName("expiry3").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            if spark.table("expiry3").count():
                break
        assert [r.job_id for r in spark.table("expiry3").collect()] == [1]
    finally:
        query.stop()
