"""Small helpers that the text operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thawline.llm import textbytes as tb


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that of the session's checkpoints.

    Where neither is set, a temporary one in local mode (tests); on a cluster ValueError, since executors don't share
    local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Within it, the folders that ``materialize`` writes are added to ``paths``."""
    before = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(before)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of tables that nothing reads any more, in whatever store they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def free(spark: SparkSession, paths: list[str]) -> None:
    """``remove``, and ask for what Spark drops once the driver has collected what refers to it: shuffle files and broadcasts."""
    remove(spark, paths)
    time.sleep(0.5)  # Spark's listeners hold the last query for a moment
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/thawline/{uuid.uuid4().hex}/{label}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it, queries run with these settings of the session; after it the session's own are back, unset ones unset."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession, size: str = "4m") -> AbstractContextManager[None]:
    """Within it, queries that run send Python batches of about ``size`` at most, a row at least.

    Spark's 64 MB, where rows are long, are held beside the heap by the JVM and by each worker, some of it twice. Rows
    come all the same.
    """
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": size})


def small_rounds(spark: SparkSession) -> AbstractContextManager[None]:
    """For a loop of many queries that shuffle little: within it they are planned once, over as many partitions as there are cores.

    Adaptive plans run each exchange and each result in a thread of its own that the driver keeps for a minute, so a loop
    would leave it hundreds of stacks, and they describe a query anew after each stage.
    """
    return settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: Column | str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % mod


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer (a file of one row group is one partition).

    Partitions are counted by a query that reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < held < cores else df


def add_columns(docs: DataFrame, text: str, make: Callable[[pa.Array], list[pa.Array]], ddl: str, keep_text: bool = False) -> DataFrame:
    """Rows of ``docs`` with the columns of ``ddl`` that ``make`` gives for slices of the text column.

    Other columns stay, whatever their names (``text`` with ``keep_text``); those of the same name as a new one are
    replaced.
    """
    new = T.StructType.fromDDL(ddl)
    taken = {f.name.lower() for f in new}
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text.lower())
    kept = [i for i, c in enumerate(docs.columns) if (keep_text if i == at else c.lower() not in taken)]
    others = [i for i in kept if i != at]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(f"c{at}", *[f"c{i}" for i in others])
    schema = T.StructType([plain.schema[f"c{i}"] for i in kept] + new.fields)

    def work(batches):
        for big in batches:
            for batch in tb.slices(big, f"c{at}"):
                held = [batch.column(batch.schema.get_field_index(f"c{i}")) for i in kept]
                yield pa.RecordBatch.from_arrays([*held, *make(batch.column(0))], names=schema.names)

    return plain.mapInArrow(work, schema).toDF(*[docs.columns[i] for i in kept], *new.names)
