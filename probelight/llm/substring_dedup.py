"""Substring dedup on a compacted de Bruijn graph of word k-mers.

A window is ``WINDOW`` consecutive words of one document; a window whose words also start earlier (smaller id, or earlier
in the same document) is a repeat, and every word under a repeat goes.  Windows are judged on the input.

* Edges.  A window's anchor is its least 6-word k-mer by hash.  Consecutive windows with one anchor are one edge: words
  from its first window to its last.  Equal windows have equal anchors, so repeats always meet under an anchor.  Edges go
  to the shared folder once (about one for eight words).
* Repeated edges.  One aggregation by anchor counts edges, compares their contents (words, extent and next anchor) and
  keeps the first source coordinate.  Anchors met once drop out.
* Compaction.  An anchor with one content doesn't branch.  Where the next anchor in its first source is also unbranched
  and as frequent, every copy goes on alike; such paths are joined up along their first source's coordinates and only
  their heads are looked up again, one lookup for a whole repeated path.
* Coordinates.  Occurrences of heads join the paths and give repeated spans, except at the path's own first source.
  Edges of branching anchors join their content's first source in the same way; of these first sources alone a second
  scan gives the single windows, which are compared by their own first coordinates.

Bloom filters of fixed largest size only thin out what is sent to these joins.  Word sequences are compared by 64-bit
hash under a shared anchor (another 64 bits).  Null or blank text has no words.  Rows with a null id are returned whole
and are no source.  Rows that repeat an id are taken as one document: its spans apply to each by position.  Very long
texts are taken whole; their paths are cut every ``REACH`` words of the first source.  Of equal windows the first by id and
place stays, so ties don't arise.  Input columns named like an added column are replaced by it.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import free_name, materialize, settings, slices, table, utf8, without

WINDOW, ANCHOR, MOST_BITS, BATCH_BYTES, BATCH_ROWS, REACH = 20, 6, 1 << 28, 1 << 20, 1000, 1 << 16
_STEPS = WINDOW - ANCHOR + 1
_B = [pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(6)]  # odd base and its powers 1, 2, 4, ...


class Words(dict):
    """64-bit hash of a word, remembered for about the last quarter million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Edges:
    """The edges of a batch of documents, in order: arrays over edges, and window hashes by place in ``w``."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.n_words = np.array([len(s) for s in split], dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(self.n_words)))
        w = np.fromiter((h for s in split for h in map(_words.__getitem__, s)), np.uint64, int(at[-1]))
        empty = np.empty(0, np.int64)
        self.doc = self.start = self.n = self.place = empty
        self.anchor = self.content = empty.astype(np.uint64)
        if w.size < WINDOW:
            return
        p = [np.uint64(x) for x in _B]
        join = lambda x, y, by, power: x[: y.size - by] * power + y[by:]
        h1 = _mix(w)
        h2 = join(h1, h1, 1, p[0])
        h4 = join(h2, h2, 2, p[1])
        h6 = _mix(join(h4, h2, 4, p[1]))
        h8 = join(h4, h4, 4, p[2])
        h16 = join(h8, h8, 8, p[3])
        self.window = _mix(join(h16, h4, 16, p[2]))  # 20 words
        value, where = h6, np.arange(h6.size)
        span = 1
        while span < _STEPS:  # leftmost least k-mer of a growing span
            by = min(span, _STEPS - span)
            n = value.size - by
            first = value[:n] <= value[by:]
            value, where = np.where(first, value[:n], value[by:]), np.where(first, where[:n], where[by:])
            span += by
        of = np.repeat(np.arange(len(split)), self.n_words)[: where.size]
        ok = np.flatnonzero(np.arange(where.size) + WINDOW <= at[1:][of])
        if not ok.size:
            return
        new = np.flatnonzero(np.concatenate(([True], (np.diff(ok) != 1) | (of[ok[1:]] != of[ok[:-1]]) | (where[ok[1:]] != where[ok[:-1]]))))
        self.place = ok[new]
        self.n = np.diff(np.concatenate((new, [ok.size])))
        self.doc = of[self.place]
        self.start = self.place - at[self.doc]
        self.anchor = h6[where[self.place]]
        last = np.concatenate((self.doc[1:] != self.doc[:-1], [True]))
        following = np.where(last, np.uint64(0), np.concatenate((self.anchor[1:], [np.uint64(0)])))
        shape = (self.n * 32 + where[self.place] - self.place).astype(np.uint64)
        a, b = self.window[self.place], self.window[self.place + self.n - 1]
        self.content = _mix(_mix(_mix(a + shape) * p[1] + b) * p[2] + following)

    @staticmethod
    def first_in_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True where a key is met for the first time in its document (rows in order)."""
        order = np.lexsort((np.arange(key.size), key, doc))
        k, d = key[order], doc[order]
        out = np.empty(key.size, bool)
        out[order] = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if key.size else np.empty(0, bool)
        return out


def _lists(doc: np.ndarray, n_docs: int, values: np.ndarray) -> pa.ListArray:
    offsets = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def edges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document with a window: id, anchors a, contents c, places rn = start * 16 + windows, or ~rn where the anchor isn't the document's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, BATCH_BYTES):
            e = Edges(utf8(batch.column(text_col)))
            rn = e.start * 16 + e.n
            rn = np.where(e.first_in_doc(e.anchor, e.doc), rn, ~rn)
            lists = [_lists(e.doc, batch.num_rows, x) for x in (e.anchor.view(np.int64), e.content.view(np.int64), rn)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *lists], names=["id", "a", "c", "rn"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col)
    return rows.mapInArrow(run, "id long, a array<long>, c array<long>, rn array<long>").filter(F.size("a") > 0)


def repeated_anchors(found: DataFrame) -> DataFrame:
    """Anchors of at least two edges: a, m (edges), branching, first_id, first_start, first_n."""
    rows = found.select("id", F.explode(F.arrays_zip("a", "c", "rn")).alias("e")).select("id", "e.a", "e.c", "e.rn")
    agg = rows.groupBy("a").agg(
        F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("id").alias("first_id"),
        F.min_by("rn", F.when(F.col("rn") >= 0, F.col("id"))).alias("rn"),
    )
    return agg.filter("m > 1").select(
        "a", "m", (F.col("low") != F.col("high")).alias("branching"), "first_id", F.floor(F.col("rn") / 16).cast("long").alias("first_start"), (F.col("rn") % 16).alias("first_n"))


def paths(anchors: DataFrame) -> DataFrame:
    """Unbranched paths: head anchor a, m, first_id, first_start and n windows."""
    reach = F.floor(F.col("first_start") / REACH)  # a very long document's paths are cut there, so that groups are bounded
    w = Window.partitionBy("first_id", reach).orderBy("first_start")
    end = F.col("first_start") + F.col("first_n")
    goes_on = (F.lag(end).over(w) == F.col("first_start")) & (F.lag("m").over(w) == F.col("m"))
    marked = anchors.filter("NOT branching").withColumn("head", ~F.coalesce(goes_on, F.lit(False)))
    numbered = marked.withColumn("path", F.sum(F.col("head").cast("int")).over(w))
    whole = Window.partitionBy("first_id", reach, "path")
    return numbered.withColumn("n", F.max(end).over(whole) - F.col("first_start")).filter("head").select("a", "m", "first_id", "first_start", "n")


def _occurrences(found: DataFrame, filt) -> DataFrame:
    """Edges whose anchor the filter has: a, c, id, start, n; first: the content's first in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(a.offsets.to_numpy()))
            anchors, c, rn = (x.flatten().to_numpy() for x in (a, batch.column("c"), batch.column("rn")))
            hit = np.flatnonzero(bloom.has(filt.value, anchors.view(np.uint64)))
            rn = np.where(rn < 0, ~rn, rn)[hit]
            ids = batch.column("id").to_numpy()[doc[hit]]
            first = Edges.first_in_doc(anchors[hit] ^ c[hit], doc[hit])
            yield pa.RecordBatch.from_pydict({"a": pa.array(anchors[hit]), "c": pa.array(c[hit]), "id": pa.array(ids), "start": pa.array(rn >> 4), "n": pa.array(rn & 15), "first": pa.array(first)})

    return found.select("id", "a", "c", "rn").mapInArrow(run, "a long, c long, id long, start long, n long, first boolean")


def _place_key(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mix(_mix(ids.astype(np.int64).view(np.uint64)) + start.astype(np.int64).view(np.uint64))


def _windows(docs: DataFrame, id_col: str, text_col: str, filt) -> DataFrame:
    """Windows of the edges whose place the filter has: a, h, id, start, or ~start where the window isn't the document's first of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, BATCH_BYTES):
            e = Edges(utf8(batch.column(text_col)))
            ids = batch.column(id_col).to_numpy()
            hit = np.flatnonzero(bloom.has(filt.value, _place_key(ids[e.doc], e.start)))
            n = e.n[hit]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, start = np.repeat(e.doc[hit], n), np.repeat(e.start[hit], n) + step
            h = e.window[np.repeat(e.place[hit], n) + step] if n.size else np.empty(0, np.uint64)
            start = np.where(e.first_in_doc(h, doc), start, ~start)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.repeat(e.anchor[hit], n).view(np.int64)), "h": pa.array(h.view(np.int64)), "id": pa.array(ids[doc]), "start": pa.array(start.astype(np.int64))})

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col)
    return rows.mapInArrow(run, "a long, h long, id long, start long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Spans (id, start, end) in words, whose union is what repeats earlier windows."""
    sc = docs.sparkSession.sparkContext
    found = materialize(edges(docs, id_col, text_col), "edges")
    anchors = materialize(repeated_anchors(found), "anchors")
    heads = materialize(paths(anchors), "paths")
    seen = _occurrences(found, sc.broadcast(bloom.key_filter(heads.select("a"), most_bits))).select("a", "id", "start")
    on_paths = (
        seen.join(heads, "a").filter("NOT (id = first_id AND start = first_start)")
        .select("id", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end"))
    )
    branching = anchors.filter("branching").select("a")
    edge = materialize(_occurrences(found, sc.broadcast(bloom.key_filter(branching, most_bits))), "branching-edges")
    classes = edge.groupBy("a", "c").agg(F.min("id").alias("first_id"), F.min_by("start", F.when(F.col("first"), F.col("id"))).alias("first_start"))
    classes = materialize(classes, "edge-contents")
    not_first = "NOT (id = first_id AND start = first_start)"
    copies = edge.join(classes, ["a", "c"]).filter(not_first).select("id", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end"))
    places = classes.select("first_id", "first_start").mapInArrow(_keys, "k long")
    wins = materialize(_windows(docs, id_col, text_col, sc.broadcast(bloom.key_filter(places, most_bits))), "windows")
    first = wins.groupBy("a", "h").agg(
        F.count("*").alias("m"), F.min("id").alias("first_id"), F.min_by("start", F.when(F.col("start") >= 0, F.col("id"))).alias("first_start"),
    ).filter("m > 1").drop("m")
    # written first, as the other tables are, so that both sides of each join are plain shuffles: Spark splits a hot key only then
    first = materialize(first, "window-firsts")
    place = F.when(F.col("start") < 0, -1 - F.col("start")).otherwise(F.col("start"))
    single = (
        wins.withColumn("start", place).join(first, ["a", "h"]).filter(not_first)
        .select("id", "start", (F.col("start") + WINDOW).alias("end"))
    )
    return on_paths.union(copies).union(single)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"k": pa.array(_place_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as text, and n_words and n_removed (long)."""
    docs = without(docs, "n_words", "n_removed")
    names, key, mine, listed = docs.columns, free_name(docs, "_key"), free_name(docs, "_span_id"), free_name(docs, "_spans")
    # whole texts go to Python: the usual 10,000 rows a batch would hold hundreds of MB where texts are long
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        spans = repeated_spans(docs.select(id_col, text_col), id_col, text_col, most_bits)
        by_doc = materialize(spans.groupBy(F.col("id").alias(mine)).agg(F.collect_list(F.struct("start", "end")).alias(listed)), "spans")
    # only documents that may have spans are shuffled; a document wrongly taken for one costs its shuffle alone
    filt = docs.sparkSession.sparkContext.broadcast(bloom.key_filter(by_doc.select(F.xxhash64(mine).alias(key)), most_bits))
    keyed = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"))))
    suspect = free_name(docs, "_suspect")
    known = bloom.marked(keyed, key, filt, suspect)
    joined = known.filter(F.col(suspect)).drop(suspect).join(by_doc, F.col(id_col) == F.col(mine), "left").drop(mine)
    whole = known.filter(~F.col(suspect)).drop(suspect).withColumn(listed, F.lit(None).cast(by_doc.schema[listed].dataType))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, BATCH_BYTES):
            texts, n_words, n_removed = [], [], []
            spans = batch.column(listed)
            for k, text in enumerate(utf8(batch.column(text_col))):
                ws = text.split()
                n = len(ws)
                if spans[k].is_valid:
                    s = spans[k].values
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(s.field("start").to_numpy(), n), 1)
                    np.add.at(edge, np.minimum(s.field("end").to_numpy(), n), -1)
                    keep = np.cumsum(edge)[:n] == 0
                    ws = [w for w, x in zip(ws, keep.tolist()) if x]
                texts.append(b" ".join(ws))
                n_words.append(n)
                n_removed.append(n - len(ws))
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    return joined.mapInArrow(run, schema).union(whole.mapInArrow(run, schema))


def op5_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r
), ws AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), k AS (
  SELECT ws.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY ws.p) FILTER (gone.p IS NULL) AS kept
  FROM ws LEFT JOIN gone ON ws.doc_id = gone.doc_id AND ws.p = gone.p GROUP BY ws.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
