"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) takes a new temporary folder; on a
    cluster no machine's own folder would do, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all machines share")
            root = tempfile.mkdtemp(prefix="spark-")
        _folders[app] = f"{root.rstrip('/')}/ethanode-{app}"
        atexit.register(_drop, spark, _folders[app])
    return _folders[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str, codec: str = "snappy", placed: bool = False) -> DataFrame:
    """Like `materialize`, in as many buckets of `key` as a shuffle has partitions: what joins or groups by `key` reads it without another shuffle.

    `placed` rows already lie as a bucketed table of the same key was read, and are not dealt out again.
    """
    spark = df.sparkSession
    buckets, label = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{label}"
    rows = df if placed else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).option("path", path).option("compression", codec).format("parquet").saveAsTable(label)
    out = spark.table(label)
    spark.sql(f"DROP TABLE {label}")  # its name only: the files are outside the warehouse
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for t in tables:
        _drop(t.sparkSession, t.scratch_path)
