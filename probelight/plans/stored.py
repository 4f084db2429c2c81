"""Tables that are computed once per application and input, written to the shared folder and read from there.

Written are the tables that many queries read and that are small beside the facts (``WRITTEN``), when a query first asks
for them.  Coverage, facts and the metric tables over them are views: a query's filters and columns reach down to the
given tables, so it shuffles the builds, sessions and columns that it asks for, and no copy of all facts with all their
names is written.  The folder goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session gets a temporary folder, and a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return path.rstrip("/")


#: Tables that are written; the others are views.
WRITTEN = frozenset({"m0", "raw_methods", "raw_builds", "instances", "sessions"})


class Tables(dict):
    """Tables by name; one that isn't there yet is made by its maker and, with ``root`` and if it is among ``WRITTEN``, written and read again.

    ``width`` is the most words that a probe vector of these tables has, if that is known; ``made`` names what makers made.
    """

    def __init__(self, spark: SparkSession, makers: dict[str, Callable[[Tables], DataFrame]], root: str | None = None, given: dict[str, DataFrame] | None = None, width: int | None = None):
        super().__init__(given or {})
        self.spark, self.makers, self.root, self.width, self.made = spark, makers, root, width, set()

    def __missing__(self, name: str) -> DataFrame:
        df = self.makers[name](self)
        if self.root and name in WRITTEN:
            path = f"{self.root}/{name}"
            df.write.mode("overwrite").parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self[name] = df
        self.made.add(name)
        return df

    def __or__(self, other: dict[str, DataFrame]) -> Tables:
        out = Tables(self.spark, self.makers, self.root, {**self, **other}, self.width)
        out.made = self.made - other.keys()
        return out


def metric_tables(store) -> dict[str, DataFrame]:
    """The plans' tables over a store that ``run_etl`` writes; those that nothing was loaded into aren't there."""
    names = {"mapping": "test_to_code_mapping", "definitions": "test_definitions", "launches": "test_launches", "sessions": "test_sessions", "session_builds": "test_session_builds"}
    same = ("builds", "methods", "build_methods", "build_method_coverage", "method_daily_coverage", "session_coverage", "definition_coverage", "test_launches")
    found = {k: store.read(name) for k, name in [*names.items(), *((x, x) for x in same)]}
    return {k: df.withColumnRenamed("updated_at_day", "created_at_day") if k.endswith("_coverage") else df for k, df in found.items() if df is not None}


_kept: dict[tuple[str, str], tuple[tuple, Tables]] = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of an input's tables, by which a rewritten one is known."""
    where = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(where):
        inside = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inside]
    return tuple(sorted(out))


def tables(spark: SparkSession, sf_dir: str, make: Callable[[], Tables]) -> Tables:
    """The tables of an input, kept for the application as long as the input's files are the same."""
    key, files = (spark.sparkContext.applicationId, sf_dir), _files(spark, sf_dir)
    if key not in _kept or _kept[key][0] != files:
        t = make()
        t.root = f"{shared_dir(spark)}/coverage-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(t.root)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        _kept[key] = (files, t)
    return _kept[key][1]
