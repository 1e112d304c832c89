"""Jobs that are made once: a stream over the folder they arrive in, whose log says what is done when a run is started again.

The checkpoint holds which job files a run has taken and, as state, every case that was made; the sink's own log names the files
of finished batches. A run that is killed leaves an unfinished batch, whose files no reader sees and which the next run makes anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def run(spark: SparkSession, jobs: str, out: str, log: str, keys: list[str], make: Callable[[DataFrame], DataFrame], files: int = 100, seconds: int | None = None) -> bool:
    """Make all jobs that have arrived below `jobs` (Parquet) and are not done; whether that came to its end in time.

    A case is its keys: the same case in another file, or sent again, is not made twice. `make` takes and returns rows and keeps the
    keys; it may fail, which ends the run with its error. `files` job files are a batch. Nulls in keys are values like others.
    """
    arriving = spark.readStream.schema(spark.read.parquet(jobs).schema).option("maxFilesPerTrigger", files).parquet(jobs)
    made = make(arriving.dropDuplicates(keys))
    query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination(seconds)
        return not query.isActive
    finally:
        query.stop()


def finished(spark: SparkSession, out: str, keys: list[str]) -> DataFrame | None:
    """The keys of finished cases, by the sink's log; None before a batch has ended."""
    try:
        return spark.read.parquet(out).select(*keys)
    except AnalysisException:
        return None


def pending(spark: SparkSession, jobs: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """Jobs that are not finished by the log."""
    done = finished(spark, out, keys)
    if done is None:
        return jobs
    same = [jobs[k].eqNullSafe(done[k]) for k in keys]
    return jobs.join(done, same, "left_anti")
