"""Session settings and the shared folder used to cut lineage."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="hourgrid", master=None, **conf) -> SparkSession:
    """A session with the settings the operators assume; `conf` keys use `__` for `.`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Windows leave rows laid out by grid; joins on (grid, time) may then reuse that layout.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="hourgrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the files; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for frames that several others are derived from.

    Each call has a folder of its own, so nothing is carried over from one query to the next.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, sort=()) -> DataFrame:
    """`df` as a table in the shared folder, bucketed by `key` and sorted inside its files.

    Windows and joins whose keys include `key` need no exchange then; for joins, `requireAllClusterKeysForCoPartition`
    must be off, as `build_session` sets it. One file a bucket, as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *sort).option("path", path).saveAsTable(table)
    return spark.table(table)
