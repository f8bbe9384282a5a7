"""What the corpus operators share: the shared folder, stage tables and batch sizes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that a Python worker holds as strings at once, besides one row that may be longer.
SLICE_CHARS = 4_000_000

#: Rows of an Arrow batch of texts at most.
BATCH_ROWS = 2_000
#: Bits of the map of ``bit_map``.
MAP_BITS = 1 << 22

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (local tests) a temporary one is made and set; elsewhere that is an error,
    as executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the session's process ends."""
    if not _made:
        atexit.register(drop_all)
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def store(path: str):
    """The file system of a path in the shared folder, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path  # for drop()
    return out


def drop(*tables: DataFrame | str) -> None:
    """Removes tables of ``keep`` (or paths) that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_quire_path", None)
        spark = _made.pop(path, None)
        if spark is not None:
            try:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # noqa: BLE001 - a closing session can't delete; the folder is temporary
                return


def drop_all() -> None:
    drop(*list(_made))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``BATCH_ROWS``: texts are long, and a batch stands in the executor and in its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under names of their own, whatever else ``docs`` holds, for maps over Arrow batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


class BitMap:
    """Whether a value may be one of those that a map of hashed values was made of, as a column function; ``among`` keeps such elements of an array.

    The map is a table of one row that a scalar subquery reads: as a literal it would stand in the text of every plan, which the driver holds for each query that ran.
    """

    def __init__(self, table: DataFrame, bits: int):
        self.table, self.bits = table, bits

    def _test(self, held: Column, v: Column | str) -> Column:
        at = _spot(v, self.bits)
        return F.getbit(F.get(held, (at / 64).cast("int")), at % 64) == 1

    def __call__(self, v: Column | str) -> Column:
        return self._test(self.table.scalar(), v)

    def within(self, made: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``made`` of the test, for use in functions of elements. No subquery may stand there, so that the map is a literal."""
        held = F.split(F.lit(",".join(map(str, self.table.first()["held"]))), ",").cast("array<bigint>")  # folded once; a list of literals would take the driver long
        return made(lambda v: self._test(held, v))

    def among(self, values: Column | str) -> Column:
        return self.within(lambda test: F.filter(values, test))


def _spot(v: Column | str, bits: int) -> Column:
    return F.pmod(F.xxhash64(v), F.lit(bits)).cast("int")


def bit_map(df: DataFrame, value: Column | str, bits: int = MAP_BITS) -> BitMap:
    """The map of ``value`` in ``df``, whose size is fixed: when full it only lets more through."""
    words = df.select(_spot(value, bits).alias("spot")).groupBy((F.col("spot") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, spot % 64))").alias("b"))
    every = df.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    whole = words.unionByName(every).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    return BitMap(keep(whole.agg(F.sort_array(F.collect_list(F.struct("w", "b")))["b"].alias("held")), "map"), bits)  # bits / 64 words


def releasing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` for a map over batches; at the end of a task its Python worker, which outlives it, hands freed memory back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts are about ``chars`` bytes at most (a longer row stands alone)."""
    text = batch.column(batch.schema.get_field_index(column))
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(size):
        if total and total + n > chars:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)
