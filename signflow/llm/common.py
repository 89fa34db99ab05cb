"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.storage import numbered


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is ``spark.checkpoint.dir`` of the session.  Where that is unset, a local
    session, as in tests, gets a temporary folder, and a cluster's raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="signflow-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows of an Arrow batch, of which a Python worker holds a few at a time.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, as texts can be long; a session's own setting stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/signflow/{label}-{uuid.uuid4().hex}"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that ``materialise`` makes meanwhile, in order, for whoever wants to remove them."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a frame that ``materialise`` made."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within_bytes(df: DataFrame, size: Column, order: Column, most: int) -> DataFrame:
    """The first rows of ``df`` by ``order`` whose sizes add up to at most ``most``: all of them where they fit."""
    if (df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) <= most:
        return df
    sized = df.withColumns({"__order": order, "__size": size})
    return numbered(sized, "__order", *df.columns, name="__place", total="__size").where(F.col("__size_before") + F.col("__size") <= most).select(*df.columns)


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents kept from all learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2
