"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it has none, a local session gets a temporary folder and a cluster's raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="signflow-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/signflow/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, whole or not at all; False if it is there already, whoever else tries at the same time.

    On a local disk a hard link to a finished file decides, elsewhere a rename
    that doesn't overwrite, which the file system does as one step.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Exception:
            if fs.exists(target):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], label: str, max_rounds: int = 10_000_000) -> DataFrame:
    """All rows that ``step`` derives from ``seed``, each once.

    Only the rows that are new take part in the next round.  Each round is a
    distinct and an anti join; every eight rounds the rows found are put into
    one table, so that the plan stays short.
    """
    seen = front = store(seed.distinct(), label)
    for k in range(max_rounds):
        front = store(step(front).select(*seed.columns).distinct().join(seen, seed.columns, "left_anti"), label)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if k % 8 == 7:
            seen = store(seen, label)
    raise RuntimeError(f"{label}: no fixpoint in {max_rounds} rounds")


def numbered(df: DataFrame, *order: str | Column, name: str = "number", total: str | None = None) -> DataFrame:
    """``df`` with the place, from 0, of each row in a total order, and the running sum of column ``total`` before it.

    Rows are dealt out by ranges of the order and numbered within a range; of
    the ranges only their sizes are added up in one place, so no task gets all
    rows.  The order should tell all rows apart.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = store(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__range").orderBy(*keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    add = [F.count("*").alias("__n")]
    if total:
        rows = rows.withColumn(f"{total}_before", F.coalesce(F.sum(total).over(before), F.lit(0)))
        add.append(F.sum(total).alias("__t"))
    # one row a range
    sizes = cut.groupBy("__range").agg(*add)
    past = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = [F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__n0")] + ([F.coalesce(F.sum("__t").over(past), F.lit(0)).alias("__t0")] if total else [])
    rows = rows.join(F.broadcast(sizes.select("__range", *base)), "__range").withColumn(name, F.col(name) + F.col("__n0"))
    if total:
        rows = rows.withColumn(f"{total}_before", F.col(f"{total}_before") + F.col("__t0")).drop("__t0")
    return rows.drop("__range", "__n0")
