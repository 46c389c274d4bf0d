"""Session helpers: table access, the shared work folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest estimated size of a side that operators broadcast after having counted it.
BROADCAST_BYTES = 32 << 20

_local_dirs: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may run without that setting; then a temporary folder stands in, which is
    shared there by definition. A cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="sightline-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return f"file://{_local_dirs[app]}"


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/sightline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a lineage cut that needs no executor to stay alive."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether df, by a count of its rows, stays under BROADCAST_BYTES; df should be a written table, as it is counted."""
    bound = BROADCAST_BYTES // row_bytes
    return df.limit(bound + 1).count() <= bound
