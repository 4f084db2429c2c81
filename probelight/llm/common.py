"""Helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: U+0020 and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local session gets a temporary folder of this machine; a cluster is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
        path = _own[sc.applicationId]
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def open_folder(path: str):
    """(file system, path in it) of a folder that tasks share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; whatever is there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = _fs(spark, path)
    fs.deleteOnExit(where)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once no frame needs it any more."""
    for df in written:
        delete_path(df.sparkSession, df._written_at)


#: Whole texts go to Python workers in batches of at most so many rows and bytes, as JVM and worker each hold copies.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; the former ones come back after it."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix totals of an array under an associative ``join``, in steps that double their reach."""
    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    step = lambda acc, by: F.transform(acc, lambda x, i: F.when(i >= by, join(x, F.get(acc, i - by))).otherwise(x))
    return F.aggregate(reach, values, step)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator adds itself (compared as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words of a text as Spark expressions; null or blank: no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most_bytes`` of text (one row at least), which bounds memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def spread(df: DataFrame) -> int:
    """How many partitions a keyed shuffle gets: the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
