"""Where intermediate results live: the folder that the cluster shares."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders of the `cleaned` calls that run, the innermost last.
_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())
#: Slices that a table is written in at most.
MOST_SLICES = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder, which is then
    that session's spark.checkpoint.dir."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="escarp-")
        context._conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    folders = _folders.get()
    return f"{folders[-1] if folders else shared_folder(spark)}/escarp-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: it survives lost executors and is not
    computed twice.  `dropped` removes it, or the end of the `cleaned` function that wrote it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._escarp_path = path
    return out


def alone(df: DataFrame, label: str) -> DataFrame:
    """`written`, after which the shuffle files of its making go: Spark keeps them until the driver happens to collect
    its garbage, so that those of one step would lie beside those of the next."""
    out = written(df, label)
    settle(df.sparkSession)
    return out


def settle(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def part_of(df: DataFrame, key: str, part: tuple[int, int] | None) -> DataFrame:
    """The rows of slice k of n, (k, n), by a hash of a column; all rows if there is no `part` or one slice."""
    return df if part is None or part[1] == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(part[1])) == part[0])


def in_pieces(make: Callable[[tuple[int, int]], DataFrame], label: str, n: int) -> DataFrame:
    """A table written in some n pieces, `make((k, n))` for each k, one after another, so that the shuffle files of one
    piece lie there at a time."""
    n, path = max(1, min(n, MOST_SLICES)), None
    for k in range(n):
        df = make((k, n))
        path = path or new_path(df.sparkSession, label)
        df.write.mode("append").option("compression", "zstd").parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        settle(out.sparkSession)
    out._escarp_path = path
    return out


def sliced(df: DataFrame, label: str, key: str, n: int) -> list[DataFrame]:
    """The frame written `alone` in some n slices by a hash of a column, each read by itself and to be `dropped` by itself,
    so that what follows can be done for one slice after another; `_escarp_part` of each is its (k, n)."""
    n = max(1, min(n, MOST_SLICES))
    if n == 1:
        only = alone(df, label)
        only._escarp_part = (0, 1)
        return [only]
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).write.option("compression", "zstd").partitionBy("_slice").parquet(path)
    settle(spark)
    out = []
    for k in range(n):
        if exists(spark, f"{path}/_slice={k}"):
            out.append(spark.read.schema(df.schema).parquet(f"{path}/_slice={k}"))
            out[-1]._escarp_path, out[-1]._escarp_part = f"{path}/_slice={k}", (k, n)
    if not out:
        out.append(spark.createDataFrame([], df.schema))
        out[-1]._escarp_path, out[-1]._escarp_part = path, (0, 1)
    return out


def cleaned(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of a frame whose result is written, and whose other tables then go, also after a failure."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        spark, outer = df.sparkSession, _folders.get()
        folder = new_path(spark, f.__name__)
        mark = _folders.set((*outer, folder))
        try:
            result = f(df, *args, **kwargs)
            _folders.reset(mark)
            mark = None
            return alone(result, f.__name__)
        finally:
            if mark:
                _folders.reset(mark)
            remove(spark, folder)

    return run


def dropped(*frames: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing reads it any more."""
    for df in frames:
        remove(df.sparkSession, df._escarp_path)


def located(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = located(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = located(spark, path)
    files.delete(where, True)
