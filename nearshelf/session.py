"""Session facts the jobs depend on."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """New path for written intermediate tables, in the shared folder that the
    cluster names in spark.checkpoint.dir. A local session without one uses the
    temporary folder; on a cluster the setting is required, as executors don't
    share local folders. The caller or the cluster cleans the folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/nearshelf-{name}-{uuid.uuid4().hex}"
