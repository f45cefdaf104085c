"""Helpers around the Spark session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where they see the same files.

    Where they do not, pass the package with ``--py-files`` as usual.
    """
    _bound_batches(spark)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def _bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers of fewer rows than Spark's default, unless the session says otherwise: texts may be long."""
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; one of our own only on a single machine that names none."""
    ship(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again; later reads take only the columns that they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    kinds = {f"c{i}": (name, kind) for i, (name, kind) in enumerate(df.dtypes)}
    held = df.toDF(*kinds)
    held.select(*[c for c, (_, kind) in kinds.items() if kind != "void"]).write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.select(*[(F.lit(None) if kind == "void" else F.col(c)).alias(name) for c, (name, kind) in kinds.items()])


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
