"""Tables kept by the parameters that made them, and a log of runs."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Part of every key: a changed normaliser makes new tables.
NORMALISER_VERSION = 1


def parameter_key(name: str, parameters: dict) -> str:
    body = json.dumps({"version": NORMALISER_VERSION, **parameters}, sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(body.encode()).hexdigest()[:16]}"


def cached(spark: SparkSession, folder: str, name: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of these parameters, built on first use. A table counts only with its success marker, so half a write is built again."""
    path = f"{folder.rstrip('/')}/{parameter_key(name, parameters)}"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def finite(value):
    """The value with NaN and infinities as None, inside lists and dictionaries too."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    return [finite(v) for v in value] if isinstance(value, (list, tuple)) else value


class RunLog:
    """Appends metrics as JSON lines and writes a summary; both are small and belong to the driver."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def log(self, **values) -> None:
        with open(f"{self.folder}/metrics.jsonl", "a", encoding="utf-8") as f:
            f.write(json.dumps(finite(values)) + "\n")

    def summary(self, **values) -> None:
        with open(f"{self.folder}/summary.json", "w", encoding="utf-8") as f:
            json.dump(finite(values), f, indent=1)
