"""Keyed upserts of Parquet tables: new partitions are computed, written beside the old ones, then pointed to.

``merged`` is the relational part: old and new rows of a key meet in one grouping over their union, nulls in keys
compared as equal.  ``Store`` keeps a table as partition folders.  A version is a manifest, the list of its folders: a
write puts the partitions it changes into new folders and the manifest last, so readers see old or new, never half, a
failed write changes nothing, and what a write costs goes with what it brings or the partitions it touches, not with the
table.  Tables are kept in one of three ways:

* by partition: an upsert rewrites the partitions that its rows fall into (coverage by build or month);
* as deltas (``DELTAS``): an upsert adds a folder with its own rows and their number in order, readers fold the rows of a
  key by the table's policy;
* as a log (``append``): a batch adds a folder, once, however often it is run.

Deltas and logs are compacted in tiers: ``FAN`` folders of a tier and partition become one of the next, so every row is
written a few times at most (the logarithm of the number of batches), and readers meet few folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from probelight.functions import probes


def merged(old: DataFrame, new: DataFrame, keys: list[str], policy: str, columns: list[str] | None = None, order: str | None = None, width: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Old content after an upsert of ``new``, whose rows come in order of the column ``order`` (which isn't kept if ``old`` lacks it).

    keep: conflicts keep the old row.  replace: new values in ``columns`` (all by default), others as they were.
    or: probes are OR-ed, updated_at_day and other columns follow ``new`` only where the probes change.
    forward: updated_at_day only advances.  Of several new rows of a key the last one counts (keep: the first), ties and
    rows without an order by the greatest (least) row; under ``or`` their probes are OR-ed first, and vectors of old and new
    rows must have equally many words; ``width`` is the most words of a vector, if it is known, and with it the rows can be
    laid out for the partitions ``by`` in the shuffle that they are merged in.
    """
    if policy == "or" and width is not None:
        return _ored(old, new, keys, width, by)
    if policy == "or":
        other = [c for c in old.columns if c not in keys and c != "probes"]
        new = probes.or_by(new.select(*keys, "probes", *other), keys, width=width, _r=F.max(F.struct(*other))) if other else probes.or_by(new.select(*keys, "probes"), keys, width=width)
        new = new.select(*keys, "probes", *(F.col(f"_r.{c}").alias(c) for c in other))
    rest = [c for c in old.columns if c not in keys]
    place = F.col(order) if order and policy != "or" else F.lit(0)
    both = old.select(*keys, *rest, F.lit(None).cast(new.select(place).schema[0].dataType).alias("_place"), F.lit(0).alias("_new"))
    both = both.unionByName(new.select(*keys, *rest, place.alias("_place"), F.lit(1).alias("_new")))
    is_new = F.col("_new") == 1
    pick = F.min if policy == "keep" else F.max
    g = both.groupBy(*keys).agg(F.max(F.when(~is_new, F.struct(*rest))).alias("_o"), pick(F.when(is_new, F.struct("_place", *rest))).alias("_n"))
    had = F.col("_o").isNotNull()
    value = {c: (F.col(f"_o.{c}"), F.col(f"_n.{c}")) for c in rest}
    out: dict[str, Column] = {}
    for c, (o, n) in value.items():
        if policy == "keep":
            out[c] = F.when(had, o).otherwise(n)
        elif policy == "replace":
            out[c] = F.when(F.col("_n").isNotNull() & (~had | F.lit(columns is None or c in columns)), n).otherwise(o)
        elif policy == "forward":
            out[c] = F.greatest(o, n) if c == "updated_at_day" else F.when(had, o).otherwise(n)
        elif policy == "or":
            unequal = F.size("_o.probes") != F.size("_n.probes")
            joined = F.when(unequal, F.raise_error(F.lit("probes of one key are of unequal length")).cast("array<bigint>")).otherwise(probes.merge(F.col("_o.probes"), F.col("_n.probes")))
            out[c] = joined if c == "probes" else F.when(had & joined.eqNullSafe(F.col("_o.probes")), o).otherwise(F.coalesce(n, o))
        else:
            raise ValueError(policy)
    return g.select(*keys, *(v.alias(k) for k, v in out.items())).select(*old.columns)


def _ored(old: DataFrame, new: DataFrame, keys: list[str], width: int, by: Sequence[str] = ()) -> DataFrame:
    """``merged`` by ``or`` at a known width: old and new rows are folded apart in one grouping, which may be by (partition, slice of keys)."""
    other = [c for c in old.columns if c not in (*keys, "probes")]
    both = old.select(*keys, "probes", *other, F.lit(False).alias("_new")).unionByName(new.select(*keys, "probes", *other, F.lit(True).alias("_new")))
    # one column needs no struct, which would have to be sorted
    rest = F.col(other[0]) if len(other) == 1 else F.struct(*other) if other else F.lit(None)
    sides = []
    for side, mine in (("o", ~F.col("_new")), ("n", F.col("_new"))):
        sides += [F.count_if(mine).alias(f"_{side}"), probes.or_vector(F.when(mine, F.col("probes")), width).alias(f"_{side}p"), F.max(F.when(mine, rest)).alias(f"_{side}r")]
    within = keys
    if by:
        both = _with_derived(both, by).withColumn("_slice", F.pmod(F.hash(*keys), F.lit(SLICES))).repartition(*by, "_slice")
        within = list(dict.fromkeys([*keys, *by, "_slice"]))
    g = both.groupBy(*within).agg(*sides)
    had, o, n = F.col("_o") > 0, F.col("_op"), F.col("_np")
    unequal = F.size(o) != F.size(n)
    joined = F.when(unequal, F.raise_error(F.lit("probes of one key are of unequal length")).cast("array<bigint>")).otherwise(probes.merge(o, n))
    stays = (F.col("_n") == 0) | (had & joined.eqNullSafe(o))
    value = lambda side, c: F.col(f"_{side}r") if len(other) == 1 else F.col(f"_{side}r.{c}")
    out = {c: F.when(stays, value("o", c)).otherwise(F.coalesce(value("n", c), value("o", c))) for c in other}
    return g.select(*keys, joined.alias("probes"), *(v.alias(c) for c, v in out.items())).select(*old.columns)


def without_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among ``gone`` (nulls are equal)."""
    g = gone.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.join(g, on, "left_anti")


#: Folder columns that follow from another column: a folder for each day would be too small.
DERIVED = {"_month": "date_format(day, 'yyyy-MM')", "_created_month": "date_format(created_at, 'yyyy-MM')"}
#: Columns that the metric tables are partitioned by, keys or derived.  Others are one partition.
PARTITIONS = {
    "method_daily_coverage": ("group_id", "_month"), "build_method_coverage": ("group_id", "build_id"), "session_coverage": ("group_id", "build_id"),
    "definition_coverage": ("group_id", "build_id"), "build_methods": ("group_id", "build_id"), "methods": ("group_id", "app_id"),
    "test_to_code_mapping": ("group_id", "app_id"), "method_coverage": ("group_id", "_created_month"),
}
#: Tables without a partition that most upserts would stay in: they are kept as deltas.
DELTAS = ("builds", "build_infos", "instances", "test_launches", "test_definitions", "test_sessions", "test_session_builds")
FAN = 16
#: Tasks and files of a partition that an upsert by OR rewrites, at most.
SLICES = 8
_NULL = "__HIVE_DEFAULT_PARTITION__"
SEQ = "_seq"


def _with_derived(df: DataFrame, by) -> DataFrame:
    return df.withColumns({c: F.expr(DERIVED[c]) for c in by if c in DERIVED})


def folded(deltas: DataFrame, keys: list[str], policy: str, columns: list[str] | None = None, width: int | None = None) -> DataFrame:
    """One row a key of deltas in order of ``_seq``, with the number of its last: what upserts one after the other give.

    Folding neighbours in order first and the results then gives the same, so folders can be compacted in parts.  That
    holds for ``or`` too where keys and probes are all there is: whether a day follows depends on all earlier rows.
    """
    if policy == "or":
        rows = deltas.withColumn("_n", F.size("probes"))
        return probes.checked_or_by(rows, keys, "_n", width=width, **{SEQ: F.max(SEQ)}).select(*deltas.columns)
    rest = [c for c in deltas.columns if c not in (*keys, SEQ)]
    row = F.struct(*rest)
    g = deltas.groupBy(*keys).agg(F.min_by(row, SEQ).alias("_first"), F.max_by(row, SEQ).alias("_last"), F.max(SEQ).alias(SEQ), *([F.max("updated_at_day").alias("_day")] if policy == "forward" else []))
    late = {"keep": (), "replace": rest if columns is None else columns, "forward": ()}[policy]
    out = {c: F.col(f"_last.{c}") if c in late else F.col(f"_first.{c}") for c in rest}
    if policy == "forward":
        out["updated_at_day"] = F.col("_day")
    return g.select(*keys, *(v.alias(c) for c, v in out.items()), SEQ).select(*deltas.columns)


class Store:
    """Tables below ``root`` on any file system Spark writes to, partitioned by ``partitions``; the last ``versions`` are kept.

    Partition columns are strings that aren't empty, or dates; nulls are a partition of their own.  One writer a table.
    """

    def __init__(self, spark: SparkSession, root: str, versions: int = 3, partitions: dict[str, tuple[str, ...]] | None = None, deltas: tuple[str, ...] = DELTAS, fan: int = FAN):
        self.spark, self.root, self.versions = spark, root.rstrip("/"), versions
        self.partitions, self.deltas, self.fan = PARTITIONS if partitions is None else partitions, deltas, fan

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self, table: str) -> list[str]:
        fs, folder = self._fs(), self._path(table, "_current")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _manifest(self, table: str, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{table}/_current/{name}", wholetext=True).first().value)

    def _latest(self, table: str) -> dict | None:
        names = self._manifests(table)
        return self._manifest(table, names[-1]) if names else None

    def _load(self, table: str, m: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{x}" for x in folders)).select(*schema.names)

    def _content(self, table: str, m: dict) -> DataFrame:
        df = self._load(table, m, m["folders"])
        if "merge" not in m:
            return df
        return (folded(df, **m["merge"]) if len(m["folders"]) > 1 else df).drop(SEQ)

    def read(self, table: str) -> DataFrame | None:
        m = self._latest(table)
        return self._content(table, m) if m else None

    def _write(self, table: str, df: DataFrame, by: tuple[str, ...], laid_out: bool = False) -> tuple[dict, list[str]]:
        """Writes ``df``, which may be laid out by partition already, into new folders; returns its schema and the folders."""
        fs, version = self._fs(), f"_v={uuid.uuid4().hex}"
        schema = StructType([f for f in df.schema if f.name not in by] + [f for f in df.schema if f.name in by]) if by else df.schema
        # each partition in few files; adaptive execution splits those that are too large for a task
        placed = _with_derived(df, by)
        ((placed if laid_out else placed.hint("rebalance", *by)).write.partitionBy(*by) if by else df.write).parquet(f"{self.root}/{table}/{version}")
        new = [version]
        if by:
            found = fs.globStatus(self._path(table, version, *("*=*" for _ in by))) or []
            new = [version + s.getPath().toString().split(version, 1)[1] for s in found]
        return json.loads(schema.json()), new

    def _commit(self, table: str, m: dict) -> None:
        """The table's next version; the oldest goes."""
        names = self._manifests(table)
        number = int(names[-1].split("-", 1)[0]) + 1 if names else 0
        out = self._fs().create(self._path(table, "_current", f"{number:08d}-{uuid.uuid4().hex}"))
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        self._expire(table)

    def _add(self, table: str, df: DataFrame, by: tuple[str, ...], kept: list[str], laid_out: bool = False, **more) -> None:
        """Writes ``df`` into new folders and a version of these and the ``kept`` ones."""
        schema, new = self._write(table, df, by, laid_out)
        self._commit(table, {"by": list(by), "schema": schema, "folders": kept + new, **more})

    def _expire(self, table: str) -> None:
        """Deletes the oldest versions, and the folders that no later one names."""
        fs, names = self._fs(), self._manifests(table)
        old, live = names[: -self.versions], names[-self.versions :]
        used = {x for n in live for x in self._manifest(table, n)["folders"]} if old else set()
        for name in old:
            for x in set(self._manifest(table, name)["folders"]) - used:
                fs.delete(self._path(table, x), True)
            fs.delete(self._path(table, "_current", name), False)

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces the table's content; readers of the old one go on."""
        m = self._latest(table)
        self._add(table, df, tuple(m["by"]) if m else tuple(self.partitions.get(table, ())), [], **{k: m[k] for k in ("batches",) if m and k in m})

    @staticmethod
    def _values(folder: str) -> tuple[str, ...]:
        return tuple(unquote(x.split("=", 1)[1]) for x in folder.split("/")[1:])

    @contextmanager
    def staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` written once for several reads of some of its columns and rows, so that executors hold none of it; gone afterwards."""
        path = self._path(f"staged-{uuid.uuid4().hex}")
        try:
            df.write.parquet(path.toString())
            yield self.spark.read.schema(df.schema).parquet(path.toString())
        finally:
            self._fs().delete(path, True)

    def _touched(self, m: dict, *rows: DataFrame) -> tuple[list[str], list[str]]:
        """(folders of partitions that ``rows`` have, the others); the driver sees partition values only."""
        if not m["by"]:
            return m["folders"], []
        hit = set()
        for df in rows:
            hit |= {tuple(_NULL if v is None else str(v) for v in r) for r in _with_derived(df, m["by"]).select(*m["by"]).distinct().collect()}
        return [x for x in m["folders"] if self._values(x) in hit], [x for x in m["folders"] if self._values(x) not in hit]

    def upsert(self, table: str, new: DataFrame, keys: list[str], policy: str, columns: list[str] | None = None, without: Column | None = None, order: str | None = None, width: int | None = None) -> None:
        """Merges ``new`` into the table, of whose old rows those for which ``without`` is true go in the same write."""
        m = self._latest(table)
        none = (new.drop(order) if order else new).limit(0)
        how = {"keys": keys, "policy": policy, "columns": columns}
        if table in self.deltas and policy == "or" and set(new.columns) == {*keys, "probes"}:
            rows = folded(new.withColumn(SEQ, F.lit(0).cast("long")), keys, policy, width=width).drop(SEQ)
            return self._add_delta(table, m, rows, how | {"width": width}, without)
        if table in self.deltas and policy != "or":
            return self._add_delta(table, m, merged(none, new, keys, policy, columns, order), how, without)
        once = policy == "or" and width is not None  # merged and laid out in one shuffle
        if m is None:
            by = tuple(c for c in self.partitions.get(table, ()) if c in keys or c in DERIVED)
            return self._add(table, merged(none, new, keys, policy, columns, order, width, by if once else ()), by, [], once)
        gone = [] if without is None else [self._load(table, m, m["folders"]).filter(without)]
        touched, kept = self._touched(m, new, *gone)
        old = self._load(table, m, touched)
        if without is not None:
            old = old.filter(~F.coalesce(without, F.lit(False)))
        by = tuple(m["by"])
        self._add(table, merged(old, new, keys, policy, columns, order, width, by if once else ()), by, kept, once)

    def _add_delta(self, table: str, m: dict | None, rows: DataFrame, how: dict, without: Column | None) -> None:
        """A delta of ``rows``, one a key; rewritten whole only to drop rows, or when the way to merge changes."""
        seq = m.get("seq", 0) + 1 if m else 0
        more = {"merge": how, "seq": seq}
        if m and (without is not None or m.get("merge") != how):
            old = self._content(table, m)
            old = old if without is None else old.filter(~F.coalesce(without, F.lit(False)))
            both = merged(old, rows.select(*old.columns), how["keys"], how["policy"], how["columns"], width=how.get("width"))
            return self._add(table, both.withColumn(SEQ, F.lit(seq).cast("long")), (), [], levels=[99], **more)
        names = rows.columns if m is None else [f["name"] for f in m["schema"]["fields"] if f["name"] != SEQ]
        schema, new = self._write(table, rows.select(*names).withColumn(SEQ, F.lit(seq).cast("long")), ())
        self._commit_and_compact(table, {"by": [], "schema": schema, "folders": [*(m["folders"] if m else []), *new], "levels": [*(m["levels"] if m else []), *(0 for _ in new)], **more})

    def append(self, table: str, rows: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Adds rows.  A batch of a stream is added once: its number goes into the same manifest as its folders."""
        m = self._latest(table)
        done = m.get("batches", {}) if m else {}
        if stream is not None and done.get(stream, -1) >= batch:
            return
        by = tuple(m["by"]) if m else tuple(self.partitions.get(table, ()))
        names = rows.columns if m is None else [f["name"] for f in m["schema"]["fields"]]
        schema, new = self._write(table, rows.select(*names), by)
        old = m["folders"] if m else []
        levels = [*(m.get("levels") or [99] * len(old) if m else []), *(0 for _ in new)]
        self._commit_and_compact(table, {"by": list(by), "schema": schema, "folders": old + new, "levels": levels, "batches": done | ({} if stream is None else {stream: batch})})

    def _commit_and_compact(self, table: str, m: dict) -> None:
        """Commits ``m``, then merges the folders of each tier and partition that has ``fan`` of them, lowest tier first."""
        self._commit(table, m)
        while True:
            tiers: dict[tuple, list[int]] = {}
            for k, (folder, level) in enumerate(zip(m["folders"], m["levels"])):
                tiers.setdefault((level, self._values(folder) if m["by"] else ()), []).append(k)
            full = [(level, at) for (level, _), at in sorted(tiers.items()) if len(at) >= self.fan]
            if not full:
                return
            level = full[0][0]
            at = sorted(k for x, ks in full if x == level for k in ks)
            rows = self._load(table, m, [m["folders"][k] for k in at])
            _, new = self._write(table, folded(rows, **m["merge"]) if "merge" in m else rows, tuple(m["by"]))
            every = list(zip(m["folders"], m["levels"]))
            before, after = every[: at[0]], [x for k, x in enumerate(every) if k > at[0] and k not in at]  # a tier's deltas are neighbours
            every = [*before, *((x, level + 1) for x in new), *after]
            m = m | {"folders": [x for x, _ in every], "levels": [n for _, n in every]}
            self._commit(table, m)

    def delete(self, table: str, condition: Column | str) -> None:
        """Deletes the rows for which the condition is true; partitions without such rows stay as they are."""
        if (m := self._latest(table)) is None:
            return
        c = F.expr(condition) if isinstance(condition, str) else condition
        more = {k: m[k] for k in ("batches",) if k in m}
        if "merge" in m:
            left = self._content(table, m).filter(~F.coalesce(c, F.lit(False)))
            return self._add(table, left.withColumn(SEQ, F.lit(m["seq"]).cast("long")), (), [], levels=[99], merge=m["merge"], seq=m["seq"])
        touched, kept = self._touched(m, self._load(table, m, m["folders"]).filter(c))
        self._add(table, self._load(table, m, touched).filter(~F.coalesce(c, F.lit(False))), tuple(m["by"]), kept, **more)

    def delete_before(self, table: str, column: str, before: dict[str, date]) -> None:
        """Deletes rows whose day or time ``column`` is before their group's cut-off (groups without one keep all).

        Of a table that is partitioned by group and by the month of ``column``, months before the cut-off leave the manifest
        unread, and only the month it falls in is read and written.  Other tables are filtered.
        """
        if (m := self._latest(table)) is None or not before:
            return
        old = F.lit(False)
        for group, day in before.items():
            old = F.when(F.col("group_id") == group, F.col(column) < F.lit(str(day)).cast(dict(self._load(table, m, []).dtypes)[column])).otherwise(old)
        if len(m["by"]) != 2 or m["by"][0] != "group_id" or f"({column}," not in DERIVED.get(m["by"][1], ""):
            return self.delete(table, old)
        kept, border = [], []
        for folder in m["folders"]:
            group, month = self._values(folder)
            day = before.get(group)
            if day is None or month > day.isoformat()[:7]:
                kept.append(folder)
            elif month == day.isoformat()[:7] or month == _NULL:
                border.append(folder)
        more = {k: m[k] for k in ("batches",) if k in m}
        if border:
            return self._add(table, self._load(table, m, border).filter(~F.coalesce(old, F.lit(False))), tuple(m["by"]), kept, **more)
        self._commit(table, {"by": m["by"], "schema": m["schema"], "folders": kept, **more})
