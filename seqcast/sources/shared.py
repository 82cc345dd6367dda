"""The shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Where the tables that ``written`` returned lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor must be able to reach.

    It is set here only when the session names none, and then only in local mode.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="seqcast-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used yet; it goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where.getParent())
    files.deleteOnExit(where)
    return path


def discard_table(*tables: DataFrame) -> None:
    """Delete tables returned by ``written`` that nobody reads any more; other frames are left alone."""
    for table in tables:
        if path := _paths.pop(table, None):
            files, where = _file_system(table.sparkSession, path)
            files.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in its lineage that outlives executors.

    A parquet table rather than a checkpoint, so that later passes read only the columns they use.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table
