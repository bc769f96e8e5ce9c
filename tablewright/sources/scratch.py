"""Intermediate tables in the folder that driver and executors share (`spark.checkpoint.dir`)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that name none, by application; only one-process local sessions get one.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only a one-process local session, as in tests, may fall back to a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='tablewright-')}"
    return _local[app]


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/tablewright/{spark.sparkContext.applicationId}"


def new_place(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet and read it back: it is evaluated once, and outlives lost executors."""
    place = new_place(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no other table will read again; anything else than a stored table is left alone."""
    for df in tables:
        top = own_dir(df.sparkSession).removeprefix("file://")
        for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"{top}/" in place:
                _delete(df.sparkSession, place)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written elsewhere go with them."""
    _delete(spark, own_dir(spark))
