"""Sessions: the settings the library counts on, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Rows in one Arrow batch where the session has Spark's default: whole texts are long, batches must stay small.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROWS, _SPARK_ROWS = "1000", "10000"
_shipped: set[str] = set()


def session(name: str = "taxaflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; pass others with dots written as ``__``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (_SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python can import it.

    Also bounds Arrow batches, unless the session sets a size of its own.
    """
    if spark.conf.get(_BATCH, _SPARK_ROWS) == _SPARK_ROWS:
        spark.conf.set(_BATCH, _ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="taxaflow-"), "taxaflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than there are cores: a small table in few files.

    Larger tables have more splits and stay as they lie, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
