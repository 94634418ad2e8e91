"""What the training-data operators share: the scratch folder and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these; as a class for regular expressions, and the bytes themselves.
BLANK = r"[\x20\x09-\x0D]"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: With it, the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Temporary folders of local applications that have no spark.checkpoint.dir.
OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may go without it: then a temporary folder of this machine serves, as driver and
    executors are one process there.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in OWN_DIRS:
        OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="trainloom-")
    return f"file://{OWN_DIRS[context.applicationId]}"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their own shuffle files."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor costs no more than its own tasks.

    A table stays until `drop` or the end of the Python process, as results read it lazily.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.names: set[str] = set()
        self.spark, self.root = spark, f"{shared_dir(spark)}/trainloom-{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        with cleaned(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        for name in self.names - set(names):
            self.drop(name)
        self.names &= set(names)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before the process
            pass


def numbered(df: DataFrame, column: str = "_uid") -> DataFrame:
    """df with a number for each row; stable only once the result is written, so callers write it."""
    return df.withColumn(column, F.monotonically_increasing_id())


def boxed(df: DataFrame) -> DataFrame:
    """df's rows as one struct, `_doc`, so that no name of theirs clashes with a working column; unboxed() undoes it."""
    return df.select(F.struct("*").alias("_doc"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_doc.*")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts(rows: Column, total: int, parts: int, least: int = 256) -> Column:
    """How many tasks a key of so many rows is dealt to, so that none gets far more than an even share."""
    share = max(least, math.ceil(total / max(parts, 1)))
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(share))).cast("int")
