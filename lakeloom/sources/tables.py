"""Tables that several steps read: written once to the shared folder and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a fresh folder in local mode (tests), whose executors
    are the driver; on a cluster that is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    It cuts lineage as checkpoint() does, survives lost executors, and leaves later plans real sizes to choose joins by. Zstandard takes a third less
    disk for texts than the session's default and no more time.

    sweep: the shuffle files of that job go at once. Spark removes them when the driver collects their plan as garbage, which on a driver with room to spare
    may be long after, and steps over wide rows would pile them up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lakeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if sweep:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every table that stored() wrote in this application. Call it once results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lakeloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
