"""Streams: files inspected as they arrive, live progress, and the expiry of jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediasieve.functions.dictionaries import JOB_SECONDS
from mediasieve.jobs.reports import audit
from mediasieve.sources.media import _relative

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def inspect_arrivals(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """A streaming table of judged files, one row for each file that arrives below ``root``."""
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return audit(files.withColumn("rel_path", _relative(F.col("path"), root)))


def progress(outcomes: DataFrame) -> DataFrame:
    """(run_id, done, failed, current) of ``outcomes(run_id, ts, name, failed)``, batch or stream (update mode)."""
    return outcomes.groupBy("run_id").agg(F.count("*").alias("done"), F.count_if("failed").alias("failed"), F.max(F.struct("ts", "name")).alias("last")).select("run_id", "done", "failed", F.col("last.name").alias("current"))


def middle(rows: DataFrame, column: str, bins: int = 4096) -> float | None:
    """The exact median of a column of finite doubles, nulls left out; halfway between the two middle ones of an even number, null for none.

    Values are counted in equal bins from the least to the greatest, and those
    of the bin that holds the wanted places again, until they are settled: a
    task, and the driver, get counts of bins, never the values.
    """
    values = rows.select(F.col(column).alias("v")).where("v IS NOT NULL")
    facts = [F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")]
    n, least, most = values.agg(*facts).first()
    low, high, before = (n - 1) // 2, n // 2, 0
    while n and least < most:
        bin_no = F.floor((F.col("v") - least) / (most - least) * bins)
        counted = sorted(values.where(F.col("v").between(least, most)).groupBy(bin_no.alias("bin")).agg(*facts).collect(), key=lambda b: b.bin)
        at = 0
        while before + counted[at].n <= low:
            before += counted[at].n
            at += 1
        if before + counted[at].n <= high:  # the last of one bin and the first of the next
            return 0.5 * counted[at].most + 0.5 * counted[at + 1].least
        least, most = counted[at].least, counted[at].most
    return least


def expired(jobs: DataFrame, now: float | None, seconds: int = JOB_SECONDS) -> DataFrame:
    """Those of ``jobs(job_id, created, mtime)`` whose creation or last change is older; a missing folder (null mtime) counts as old."""
    age = F.when(F.col("mtime").isNull(), F.lit(float(seconds + 1))).otherwise(F.greatest(F.lit(now) - F.col("created"), F.lit(now) - F.col("mtime")))
    return jobs.where(age > seconds)


class ExpiringJobs(StatefulProcessor):
    """Keeps when each job was created and last changed, and gives it out when the older of both is too long ago."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "created long, changed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(rows)
        created, changed = int(seen["created_ms"].min()), seen["changed_ms"].max()
        if self.times.exists():
            old = self.times.get()
            created, changed = min(created, old[0]), max(changed, old[1]) if pd.notna(changed) else old[1]
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if seen["changed_ms"].isna().any():  # its folder is gone
            self.times.clear()
            yield self._row(key, created)
            return
        self.times.update((created, int(changed)))
        self.handle.registerTimer(min(created, int(changed)) + 1000 * self.seconds + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created = self.times.get()[0]
        self.times.clear()
        yield self._row(key, created)

    def _row(self, key, created: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "created_ms": [created]})

    def close(self) -> None:
        pass


def expire_stream(jobs: DataFrame, seconds: int = JOB_SECONDS, delay: str = "2 hours", clock: str = "event") -> DataFrame:
    """A stream of (job_id, created_ms) of jobs when time passes their end, as ``expired`` judges them.

    With the ``processing`` clock that is the wall clock: a job comes out when
    its seconds are over, whether or not anything is observed after it, and
    nothing is dropped as late. With the ``event`` clock time is that of the
    observations, for replays.

    ``jobs(job_id, created, mtime, seen)`` is a stream of observations. Event
    time is ``seen`` (without such a column, ``created``), so that a job that
    was made long ago isn't late when it is seen; observations that come more
    than ``delay`` after later ones are dropped. A null ``mtime`` is a folder
    that is gone: the job is given out at once; without the column, jobs don't
    change. State is one entry a job and goes with its timer.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock must be event or processing")
    timed = jobs.withColumn("seen", F.col("seen" if "seen" in jobs.columns else "created"))
    timed = timed.withWatermark("seen", delay) if clock == "event" else timed
    changed = F.unix_millis("mtime" if "mtime" in jobs.columns else "created")
    timed = timed.select("job_id", "seen", F.unix_millis("created").alias("created_ms"), changed.alias("changed_ms"))
    return timed.groupBy("job_id").transformWithStateInPandas(ExpiringJobs(seconds), outputStructType="job_id long, created_ms long", outputMode="append", timeMode=f"{clock}time")
