"""Tables that plans leave in the shared folder between two steps, and ranks that gather no group in one task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a group that one window ranks, about.
CHUNK = 1 << 16

_made: dict[str, SparkSession] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only a local session without one gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """A path and its file system, as Spark knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts lineage, is worked out once, survives lost executors. It goes with the process."""
    spark = df.sparkSession
    if not _made:
        atexit.register(_drop_all)
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_all() -> None:
    for path, spark in _made.items():
        try:
            at, store = path_of(spark, path)
            store.delete(at, True)
        except Exception:  # noqa: BLE001 - a closing session can't delete; the folder is temporary
            return


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``name``, each row's rank among those of its ``keys`` from 1. Rows are dealt by ranges of (keys, order), so that a group of any size is
    ranked in chunks, each moved on by the sizes of those before it. Rows of equal order are ranked in any order."""
    n = df.count()
    ranges = df.repartitionByRange(max(1, -(-n // chunk)), *keys, *order) if n > chunk else df.coalesce(1)
    held = kept(ranges.withColumn("__chunk", F.spark_partition_id()), "ranges")
    sizes = held.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    before = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__chunk").alias("__of"), (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__chunk")) - F.col("__n")).alias("__before"))
    own = held.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)))
    same = F.col("__chunk") == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return own.join(before, same).select(*df.columns, (F.col("__rank") + F.col("__before")).alias(name))
