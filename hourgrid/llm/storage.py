"""Tables staged in the folder that the cluster shares, and small session helpers."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.session import shared_folder


def staged(df: DataFrame, name: str, by: tuple = ()) -> DataFrame:
    """`df` written as Parquet under `spark.checkpoint.dir` and read back: cuts the lineage.

    Every executor can read the files, so a lost executor costs only its running tasks. Each call has a
    folder of its own. Readers that filter on the columns `by` open only the files they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`; from now on the session hands at most `BATCH_ROWS` rows and about `BATCH_BYTES` to Python at once.

    A batch is held by the executor and by its Python worker, so its size bounds the memory of both. Smaller
    settings of the session stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int("".join(c for c in conf.get(key) if c.isdigit()) or 0)
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, lengthened until no column of `df` clashes with it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SMALL_IDS = 2_000_000


def sized(rows: DataFrame, most: int = SMALL_IDS) -> DataFrame:
    """`rows` (a stored table of narrow rows; by default numbers, 16 MB) with a broadcast hint if it has `most` rows at
    most; else as it is, for a join by exchange."""
    return F.broadcast(rows) if rows.count() <= most else rows
