"""Steps written below a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each local application that was given none.
_LOCAL: dict[str, str] = {}


def is_local(master: str) -> bool:
    return bool(re.match(r"local(\[|$)", master))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset the warehouse on a cluster and a temporary folder in a
    single-process session, which is kept here, as the setting is fixed once a session runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if is_local(context.master):
            if context.applicationId not in _LOCAL:
                _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
            folder = _LOCAL[context.applicationId]
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop, system = _hadoop(spark, path)
    system.deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop, system = _hadoop(spark, path)
    system.delete(hadoop, True)


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes df as Parquet below the shared folder and reads it back, so a lost
    executor costs the rows of one step and no step runs twice. The driver's garbage is collected
    after it, which lets Spark delete the shuffle files of finished steps."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    del df  # or the JVM would keep its plan, and with it the shuffle
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._stored = path
    return out


def drop(*stored: DataFrame) -> None:
    """Removes what store() wrote for these, once nothing reads it any more."""
    for df in stored:
        remove(df.sparkSession, df._stored)
