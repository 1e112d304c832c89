"""Python data sources are registered once for each session: doing it again would take the name away for a moment."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

_lock = threading.Lock()


def register(spark: SparkSession, source: type) -> str:
    """The name under which a session knows a data source."""
    with _lock:
        known = spark.__dict__.setdefault("_vetlake_sources", set())
        if source not in known:
            spark.dataSource.register(source)
            known.add(source)
    spark.createDataFrame([], "a int")  # makes it the thread's active session, where Spark looks names up
    return source.name()
