"""Session helpers: the shared folder, materialised tables and shipping the package to workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local fallback where one process runs all."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file:///tmp/checkpoints/{os.getuid()}"
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/stepframe-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Folders written inside each open scratch().
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside the block is deleted behind it: nothing lazy that reads it may leave the block."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The rows of make(), written once; what it materialised on its way goes."""
    with scratch(spark):
        rows = make()
        inner = _SCOPES.pop()
        try:
            rows = materialise(rows, spark)
        finally:
            _SCOPES.append(inner)
    return rows


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers unless their PYTHONPATH already holds it."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if str(ROOT) in paths or getattr(spark.sparkContext, "_stepframe_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="stepframe-"), "stepframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "stepframe").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._stepframe_shipped = True


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for the Python stages that run inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)
