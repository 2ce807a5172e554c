"""Tables written once to the cluster's shared folder, for jobs that read a frame repeatedly."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only a local session may get one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def kept(frame: DataFrame) -> DataFrame:
    """The frame written as parquet below the shared folder, read back. The files stay there."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def staged(frame: DataFrame):
    """Write the frame as parquet, yield it read back, and delete the files afterwards. A local
    session without a shared folder gets the frame itself: nothing is written for it."""
    spark = frame.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local"):
        yield frame
        return
    path = f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    try:
        yield spark.read.schema(frame.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
