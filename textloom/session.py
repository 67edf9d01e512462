"""Where intermediate tables go: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and the warehouse on a cluster."""
    context = spark.sparkContext
    if path := context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return path
    local = context.master.split("[")[0] == "local"
    path = tempfile.mkdtemp(prefix="textloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    context.setCheckpointDir(path)
    return path


def durable(frame: DataFrame) -> DataFrame:
    """The same rows from reliable storage, with lineage cut."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


#: Tables that written() has made, by application.
_TABLES: dict[str, list[str]] = {}


def written(frame: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: columnar, so later readers prune columns."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(frame.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this application has written, and gives their number. Results that are still
    to be evaluated read them, so this is for when results have been stored."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def spread(frame: DataFrame) -> DataFrame:
    """The same rows over all cores, where the input has fewer splits than there are cores; larger inputs stay as read."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
