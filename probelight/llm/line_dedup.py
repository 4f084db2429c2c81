"""Line dedup with two Bloom filters.

A line's key is the line without ASCII white space at its ends, A-Z in lower case.  Keys of at least ``min_chars``
code points that occur in at least ``min_docs`` documents lose all their lines but those of the largest id.

1. One scan writes each document's line digests (128 bits).  A task's distinct hashes, packed by the part of the filter that
   they fall in, are dealt to that part: 8 bytes a line at most, however large the filter.
2. A part fills two bit arrays as hashes come: seen once, and seen again.  Parts are sized by the count of hashes, so
   the filters don't fill up.
3. Only suspected lines (digest, id) are shuffled on.  While the twice-seen array is within ``most_bits`` it is broadcast and
   picks them at the scan; beyond that the parts give the hashes that they saw again, which join the lines.  A false
   positive costs a row, never a wrong result.
4. Suspects are confirmed by exact distinct counts, which also give the largest id.  Of the documents only those that a
   small filter of the losing ids has are shuffled to their dropped keys.

Null or empty text is one empty line.  Rows with a null id don't count as documents and keep all their lines.  Rows
that repeat an id count as one document; all their lines are treated alike, so ties keep every copy of the largest id.
Very long texts and lines are read whole.  Input columns named like an added column are replaced by it.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import BATCHES, discard, free_name, materialize, settings, slices, spread, table, utf8, without

MIN_CHARS, MIN_DOCS, MOST_BITS = 40, 5, 1 << 30
#: Bytes of text that a task cuts into lines at a time.
AT_ONCE = 4 << 20
BITS_A_HASH, LEAST_PART, MOST_PART, PARTS = 8, 1 << 19, 1 << 26, 4096


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def _digests(text: bytes, min_chars: int) -> list[bytes]:
    return list({xxhash.xxh3_128_digest(k) for x in text.split(b"\n") if (k := line_key(x, min_chars)) is not None})


def _low(digests: np.ndarray) -> np.ndarray:
    """The hash that the filters use: the last 8 of each 16 bytes."""
    return digests.view(np.uint64).reshape(-1, 2)[:, 1]


def line_digests(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, n, digests): the distinct digests of a document's long lines, 16 bytes each, for rows with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, AT_ONCE):
            rows = [(i, d) for i, text in zip(batch.column(id_col).to_pylist(), utf8(batch.column(text_col))) if (d := _digests(text, min_chars))]
            yield pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows], pa.int64()), "n": pa.array([len(d) for _, d in rows], pa.int64()), "digests": pa.array([b"".join(d) for _, d in rows], pa.binary())})

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), text_col)
    return rows.mapInArrow(run, "id long, n long, digests binary")


def filter_shape(n: int) -> tuple[int, int]:
    """(parts, bits of a part): powers of two with some ``BITS_A_HASH`` bits for each of ``n`` hashes."""
    bits = bloom.size_for(n, BITS_A_HASH, 1 << 50)
    part = max(LEAST_PART, min(MOST_PART, bits // PARTS))
    return max(1, bits // part), part


def _deal(parts: int):
    """A task's distinct hashes by part: those met once, and those met in several documents already."""

    def out(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(h, return_counts=True)
        part = (h >> np.uint64(40)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        h, n, part = h[order], n[order], part[order]
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if h.size else np.zeros(1, np.int64)
        cut = [(part[a], h[a:b][n[a:b] == 1].tobytes(), h[a:b][n[a:b] > 1].tobytes()) for a, b in zip(edge, edge[1:])]
        if cut:
            p, one, more = zip(*cut)
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int64()), "one": pa.array(one, pa.binary()), "more": pa.array(more, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.concatenate([_low(np.frombuffer(x, np.uint8)) for x in batch.column("digests").to_pylist()] or [np.empty(0, np.uint64)]))
            size += held[-1].size
            if size > 1 << 22:
                yield from out(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from out(np.concatenate(held))

    return run


def _fold(bits: int, as_hashes: bool):
    """Rows come sorted by part, one part is held at a time: its twice-seen array, or the hashes that it saw again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        whole = lambda: pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int64()), "bits": pa.array([twice.tobytes()], pa.binary())})
        for batch in batches:
            for part, one, more in zip(*(batch.column(c).to_pylist() for c in ("part", "one", "more"))):
                if part != at:
                    if at is not None and not as_hashes and twice.any():
                        yield whole()
                    at, once, twice = part, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                one, more = np.frombuffer(one, np.uint64), np.frombuffer(more, np.uint64)
                again = np.concatenate((more, one[bloom.has(once, one)]))
                if as_hashes:
                    # all of them: one that the twice-seen bits have by chance was given by no earlier row
                    yield pa.RecordBatch.from_pydict({"h": pa.array(again.view(np.int64))})
                else:
                    bloom.put(twice, again)
                bloom.put(once, np.concatenate((one, more)))
        if at is not None and not as_hashes and twice.any():
            yield whole()

    return run


def suspects(lines: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(hi, lo, id): lines whose hash the filters have seen twice."""
    n = lines.agg(F.sum("n")).first()[0] or 0
    parts, bits = filter_shape(n)
    dealt = lines.select("digests").mapInArrow(_deal(parts), "part long, one binary, more binary").repartition(spread(lines), "part").sortWithinPartitions("part")
    unpacked = lambda rows: rows.mapInArrow(_unpack(None, parts, bits), "hi long, lo long, id long")
    if parts * bits > most_bits:
        # a hash seen again may be given several times; written first, so that a hot line's join can be split
        again = materialize(dealt.mapInArrow(_fold(bits, True), "h long").distinct(), "line-hashes")
        return unpacked(lines).join(again, F.col("lo") == F.col("h"), "left_semi")
    filt: dict[int, np.ndarray] = {r.part: np.frombuffer(r.bits, np.uint8) for r in dealt.mapInArrow(_fold(bits, False), "part long, bits binary").collect()}  # most_bits / 8 bytes at most
    return lines.mapInArrow(_unpack(lines.sparkSession.sparkContext.broadcast(filt), parts, bits), "hi long, lo long, id long")


def _unpack(filt, parts: int, bits: int):
    """(hi, lo, id) for each digest, of those that the filter has seen twice if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.frombuffer(b"".join(batch.column("digests").to_pylist()), np.uint8)
            ids = np.repeat(batch.column("id").to_numpy(), batch.column("n").to_numpy())
            hi, lo = d.view(np.uint64).reshape(-1, 2).T
            if filt is not None:
                hit, part = np.zeros(lo.size, bool), (lo >> np.uint64(40)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True]))) if lo.size else np.zeros(1, np.int64)
                for a, b in zip(edge, edge[1:]):
                    at = order[a:b]
                    if (one := filt.value.get(int(part[at[0]]))) is not None:
                        hit[at] = bloom.has(one, lo[at])
                hi, lo, ids = hi[hit], lo[hit], ids[hit]
            yield pa.RecordBatch.from_pydict({"hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)), "id": pa.array(ids)})

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with the kept lines as text, and the added columns n_lines and n_dropped (long)."""
    docs = without(docs, "n_lines", "n_dropped")
    names, key, mine, listed = docs.columns, free_name(docs, "_key"), free_name(docs, "_line_id"), free_name(docs, "_drop")
    hit = free_name(docs, "_hit")
    with settings(docs.sparkSession, BATCHES):
        lines = materialize(line_digests(docs, id_col, text_col, min_chars), "line-digests")
    seen = materialize(suspects(lines, most_bits), "line-suspects")
    discard(lines)
    confirmed = seen.groupBy("hi", "lo").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs)
    # written first, so that both sides of the join are plain shuffles: Spark splits a skewed one only then
    confirmed = materialize(confirmed.select("hi", "lo", "keep"), "line-keys")
    drops = seen.join(confirmed, ["hi", "lo"]).filter("id <> keep").groupBy(F.col("id").alias(mine)).agg(F.collect_set(F.struct("hi", "lo")).alias(listed))
    drops = materialize(drops, "line-drops")
    discard(seen, confirmed)
    filt = docs.sparkSession.sparkContext.broadcast(bloom.key_filter(drops.select(F.xxhash64(mine).alias(key))))
    keyed = bloom.marked(docs.withColumn(key, F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long")))), key, filt, hit)
    joined = keyed.filter(hit).drop(hit).join(drops, F.col(id_col) == F.col(mine), "left").drop(mine)
    # documents that lose nothing don't go to Python
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = keyed.filter(~F.col(hit)).select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    word = lambda x: (x & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, AT_ONCE):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(utf8(batch.column(text_col)), batch.column(listed).to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    gone = {word(d["hi"]) + word(d["lo"]) for d in drop}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema).union(whole)


def op4_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, (c.key IS NOT NULL AND k.doc_id <> c.keep) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
