"""Reading input tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir`` (any path that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests), a folder of this machine is set as
    the session's checkpoint directory. On a cluster that would lose rows, so
    there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later readers neither recompute it nor depend on the executors that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(settled: DataFrame) -> None:
    """Delete what :func:`settle` wrote for ``settled``, which must not be read again.

    Shuffle files of finished jobs go as soon as the driver has forgotten their
    plans, so both collectors are asked to run.
    """
    spark = settled.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in settled.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getName().startswith("tidewell-"):
            raise ValueError(f"{folder} was not written by settle()")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            warnings.warn(f"{folder} could not be deleted", stacklevel=2)
    gc.collect()
    spark._jvm.System.gc()
