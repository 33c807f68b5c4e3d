"""Tables of a folder, dealt over the cluster where their files have too few splits; the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(frame: DataFrame) -> DataFrame:
    """frame, or its rows dealt anew where it has fewer partitions than the cluster has cores.

    A small file is one split and would keep one core busy. A table of the size that this library
    is meant for has more splits than cores, and is read as it is, without a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder: all its columns, or those named, spread over the cluster."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(found.select(*columns) if columns else found)


_private: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a private one; a cluster is refused, as
    its executors cannot read the driver's folders.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _private.get(app) or tempfile.mkdtemp(prefix="loomspan-")
        _private[app] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/loomspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
