"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="bitik-code-")
        context.addPyFile(shutil.make_archive(f"{folder}/bitik-code", "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a directory by name."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; only on a local master, as in tests, a temporary one where that is unset.

    On a cluster a temporary folder would be another one on every machine, so a missing setting is an error there.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="bitik-shared-"))
            atexit.register(shutil.rmtree, _OWN_FOLDER[0], ignore_errors=True)
        folder = _OWN_FOLDER[0]
    return f"{folder.rstrip('/')}/bitik-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once as a parquet table in the shared folder and read it back.

    Cuts the lineage for plans that use a result several times. The files are compressed columns, outlive
    any executor, and stay until `clean`, since a result that reads them may still be unread.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote; call it when its results have been read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy row work even if the scan has fewer splits than the cluster has cores.

    A table of one small file is one split; only then rows are moved. A large scan stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df
