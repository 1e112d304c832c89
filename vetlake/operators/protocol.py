"""Protocol of a run: configuration, reports of splits, staleness of a calibration, timings."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .guards import shared_keys


def load_config(spark: SparkSession, path: str) -> dict:
    """A configuration from JSON or, where the library is there, YAML; of repeated keys the last holds."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one file
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs PyYAML; JSON does not") from e
        return yaml.safe_load(text)
    return json.loads(text)


def report(rows: DataFrame, role: str, keys: list[str]) -> DataFrame:
    """For each role its rows and distinct keys, and how many key values are shared or null over all roles."""
    out = rows.groupBy(role).agg(F.count(F.lit(1)).alias("rows"), *(F.count_distinct(k).alias(f"n_{k}") for k in keys))
    return out.crossJoin(F.broadcast(shared_keys(rows, role, keys).agg(F.count(F.lit(1)).alias("violations"))))  # one row


def output_dir(spark: SparkSession, config: dict, root: str) -> str:
    """The run's output folder below root, made where it is missing, through Hadoop's file system."""
    path = f"{root.rstrip('/')}/{config['output']}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    return path


def thread_caps(config: dict, default: int = 4) -> dict[str, str]:
    """Settings for a session's builder that hold numeric libraries in Python workers to the configuration's threads."""
    n = str(int(config.get("threads", default)))
    return {f"spark.executorEnv.{name}": n for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}


def cached(spark: SparkSession, root: str, ending: str = ".pt") -> DataFrame:
    """case_id of each finished case that has a file `<case_id><ending>` below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.expr(f"left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - {len(ending)})").alias("case_id")).where(name != ending).distinct()


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that are not done."""
    return jobs.join(done.select(*keys), keys, "left_anti")


def stale(recorded: dict, hashes: dict[str, str], config: dict) -> list[str]:
    """Why a recorded calibration does not fit these model hashes and this configuration; empty if it does."""
    out = [f"model {k}" for k in sorted(set(hashes) | set(recorded.get("model_hashes", {}))) if recorded.get("model_hashes", {}).get(k) != hashes.get(k)]
    return out + [f"config {k}" for k in sorted(set(config) | set(recorded.get("config", {}))) if recorded.get("config", {}).get(k) != config.get(k)]


def probe(rows: DataFrame, observed: str, made: str, spread: str) -> DataFrame:
    """One row: mean absolute residual, mean disagreement of seeds, whether all is finite; over arrays of pixels."""
    px = rows.select(F.explode(F.arrays_zip(F.col(observed).alias("o"), F.col(made).alias("g"), F.col(spread).alias("u"))).alias("p")).select("p.*")
    bad = F.isnan("o") | F.isnan("g") | F.isnan("u")
    return px.agg(F.avg(F.abs(F.col("o") - F.col("g"))).alias("residual_mae"), F.avg("u").alias("seed_disagreement"), F.bool_and(~bad).alias("finite"))


def save_probe(result: DataFrame, path: str) -> None:
    """Write a probe's row as strict JSON. What an earlier probe wrote is never overwritten: that raises, as do values that are not finite."""
    from ..sources.sinks import claim, strict_json

    claim(result.sparkSession, path, strict_json(result.first().asDict()) + "\n")


class Timings:
    """Seconds of named stages of a run."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
