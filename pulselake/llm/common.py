"""Shared by the operators: input columns, tables written to the cluster's shared folder, and their removal."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str, DataFrame | None]] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers started from here on import this package from where the driver has it.

    Enough where executors see that folder; elsewhere ship the package with ``--py-files`` or ``addPyFile``.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text, a null text as the empty one; other columns, whatever their names, are left behind."""
    importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in tests on one machine, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pulselake-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: ``df`` written once as Parquet in the shared folder, and read back.

    Unlike a cached or locally checkpointed frame the copy outlives executors. It is removed when Python ends, as
    frames made from it may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path, held))
    return held


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most ``rows`` rows at once from what runs inside: for rows that are large themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def removed_at_end(spark: SparkSession, path: str) -> None:
    _written.append((spark, path, None))


def discard(held: DataFrame) -> None:
    """Remove a ``written`` table now; nothing may still have to read it."""
    for k, (spark, path, frame) in enumerate(_written):
        if frame is held:
            del _written[k]
            _remove(spark, path)
            return


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def remove_written() -> None:
    while _written:
        spark, path, _ = _written.pop()
        _remove(spark, path)


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``."""
    return F.pmod(F.crc32(F.encode((F.col(key) if isinstance(key, str) else key).cast("string"), "utf-8")), F.lit(folds))
