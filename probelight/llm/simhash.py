"""SimHash near-duplicates with pivot distance tables.

A fingerprint comes from the XXH64 values (seed 42) of a text's word shingles, repeats included; A-Z count as lower
case.  Fingerprints link if at most ``most`` bits differ; classes are connected components.

* Equal fingerprints collapse first (partial aggregation), so groups of copies are one row.
* Bit blocks: of ``b`` blocks two fingerprints with at most four differing bits agree in ``b`` - 4 whole ones, so each
  fingerprint goes to a bucket for each choice of so many blocks, and every link meets in at least one.  Six blocks give 15
  buckets of about 21 bits; more fingerprints get more and wider blocks (``blocks_for``), so that buckets of unrelated
  fingerprints stay small at any size.
* In a bucket, pairs are judged by pivot tables: the Hamming distances of each fingerprint to ``PIVOTS`` reference
  fingerprints.  By the triangle inequality a pair whose largest coordinate difference exceeds ``most`` is no link and
  is discarded; survivors are verified.  Tasks return spanning forests of their links, never all pairs.
* A bucket of more than ``CHUNK`` fingerprints is cut, in order of its first pivot coordinate, into chunks; pairs of
  chunks whose coordinate ranges are further apart than ``most`` are dropped, the others are tasks of their own.

Null or blank text has fingerprint zero, which links like any other.  Rows with a null id get the class of their
fingerprint.  Repeated rows and ids are kept; of a class the smallest id names it, so ties don't arise.  Very long texts are
read whole, in slices of hashes.  Of the input's columns only the id is returned.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, slices, spread, table, utf8, without
from .components import connected_components

SHINGLE, MOST, SEED, PIVOTS, CHUNK = 4, 4, 42, 16, 2048
#: So many unrelated fingerprints may share a bucket, as a power of two.
CROWD = 4


def _pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the XXH64 values of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], dtype=np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    ws = text.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    start = np.concatenate(([0], np.cumsum(size)))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(ws) - k + 1].tolist(), (start[k:] - 1).tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, h.size, 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` and ``fp``, the fingerprint as a signed long."""
    docs = without(docs, "fp")
    names = [c for c in (keep or docs.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            fp = np.array([fingerprint(t) for t in utf8(batch.column(text_col))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp)], names=[*names, "fp"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField("fp", T.LongType())]))


def blocks_for(n: int, most: int = MOST) -> tuple[int, ...]:
    """Bits of each block: as few blocks (``most`` + 2 at least) as keep buckets of ``n`` random fingerprints small."""
    for b in range(most + 2, 2 * most + 1):
        sizes = tuple(64 // b + (k < 64 % b) for k in range(b))
        if n <= 1 << (sum(sorted(sizes)[: b - most]) + CROWD):
            break
    return sizes


def band_masks(blocks: tuple[int, ...], most: int = MOST) -> list[int]:
    """For each choice of ``len(blocks) - most`` blocks, the mask of their bits."""
    at = np.cumsum((0, *blocks))
    one = [((1 << w) - 1) << int(a) for w, a in zip(blocks, at)]
    return [sum(c) for c in combinations(one, len(blocks) - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivot distances: a row for each pivot."""
    return np.bitwise_count(fp[None, :] ^ pivots[:, None]).astype(np.int8)


def _links(fp: np.ndarray, i: np.ndarray, j: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those that link: discarded by coordinate difference, survivors verified."""
    for row in dist:
        if not i.size:
            break
        ok = np.abs(row[i] - row[j]) <= most
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= most
    return i[ok], j[ok]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): each node but the least of its class, with that least node."""
    if not a.size:
        return a, b
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: a.size], inv[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(nodes.size)
    return nodes[moved], nodes[label[moved]]


ROW = "a long, b long, bucket long, chunk long, low int, high int, fps array<long>"


def _row(a=None, b=None, bucket=None, chunk=None, low=None, high=None, fps=None) -> pa.RecordBatch:
    n = len(a) if a is not None else 1
    col = lambda x, t: pa.array(x if x is not None else [None] * n, t)
    return pa.RecordBatch.from_arrays([col(a, pa.int64()), col(b, pa.int64()), col(bucket, pa.int64()), col(chunk, pa.int64()), col(low, pa.int32()), col(high, pa.int32()), col(fps, pa.list_(pa.int64()))], names=["a", "b", "bucket", "chunk", "low", "high", "fps"])


def _in_buckets(most: int, chunk: int):
    """Rows (bucket, fp) sorted by bucket and first pivot coordinate: links of small buckets, chunks of large ones."""

    def pairs(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        here = np.flatnonzero(bucket[:-1] == bucket[1:])
        if not here.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        dist = _table(fp.view(np.uint64), _pivots())
        d, size = 1, 0
        while here.size:
            i, j = _links(fp.view(np.uint64), here, here + d, dist, most)
            a.append(fp[i])
            b.append(fp[j])
            size += i.size
            if size > 1 << 20:
                a, b = ([x] for x in forest(np.concatenate(a), np.concatenate(b)))
                size = a[0].size
            d += 1
            here = here[here + d < bucket.size]
            here = here[bucket[here] == bucket[here + d]]
        return forest(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp, cut = np.empty(0, np.int64), np.empty(0, np.int64), 0  # cut: chunks already made of the open bucket

        def as_chunk(part: np.ndarray, of: int, k: int) -> pa.RecordBatch:
            d = _table(part.view(np.uint64), _pivots(1))[0]
            return _row(bucket=[of], chunk=[k], low=[int(d.min())], high=[int(d.max())], fps=[part.tolist()])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal bucket, fp, cut
            if cut:  # the first rows go on with a bucket that is being cut
                n = int(np.searchsorted(bucket != bucket[0], True)) if bucket.size else 0
                while n >= chunk or n and (n < bucket.size or last):
                    k = min(n, chunk)
                    yield as_chunk(fp[:k], int(bucket[0]), cut)
                    bucket, fp, cut, n = bucket[k:], fp[k:], cut + 1, n - k
                if not bucket.size or n:
                    return
                cut = 0
            if not bucket.size:
                return
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            large = np.diff(edge) > chunk
            done = bucket.size if last else edge[-2]
            keep = np.repeat(~large, np.diff(edge))[:done]
            a, b = pairs(bucket[:done][keep], fp[:done][keep])
            if a.size:
                yield _row(a=a, b=b)
            for s, e in zip(edge[:-1][large], edge[1:][large]):
                if e <= done:
                    for k, at in enumerate(range(s, e, chunk)):
                        yield as_chunk(fp[at : min(at + chunk, e)], int(bucket[s]), k)
            bucket, fp = bucket[done:], fp[done:]
            if not last and bucket.size > chunk:
                yield as_chunk(fp[:chunk], int(bucket[0]), 0)
                bucket, fp, cut = bucket[chunk:], fp[chunk:], 1
                yield from flush(False)

        for batch in batches:
            bucket = np.concatenate((bucket, batch.column("bucket").to_numpy()))
            fp = np.concatenate((fp, batch.column("fp").to_numpy()))
            yield from flush(False)
        yield from flush(True)

    return run


def _of_chunks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("fps").to_pylist(), batch.column("others").to_pylist()):
                fp = np.array([*x, *y], dtype=np.int64)
                dist, n, a, b = _table(fp.view(np.uint64), _pivots()), len(x), [], []
                for at in range(0, n, 256):
                    i, j = np.meshgrid(np.arange(at, min(at + 256, n)), np.arange(n, fp.size), indexing="ij")
                    i, j = _links(fp.view(np.uint64), i.ravel(), j.ravel(), dist, most)
                    s, t = forest(fp[i], fp[j])
                    a.append(s)
                    b.append(t)
                s, t = forest(np.concatenate(a), np.concatenate(b))
                if s.size:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(s), "b": pa.array(t)})

    return run


def links(fps: DataFrame, most: int = MOST, chunk: int = CHUNK, blocks: tuple[int, ...] | None = None) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column ``fp`` exactly as all pairs within ``most`` would."""
    blocks = blocks or blocks_for(fps.count(), most)
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(band_masks(blocks, most))]
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(_pivots(1)[0])))))
    dealt = fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp").repartition(spread(fps), "bucket").sortWithinPartitions("bucket", first)
    found = materialize(dealt.mapInArrow(_in_buckets(most, chunk), ROW), "simhash")
    left = found.filter("fps IS NOT NULL").select("bucket", "chunk", "low", "high", "fps")
    right = left.select("bucket", F.col("chunk").alias("chunk2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("fps").alias("others"))
    near = left.join(right, "bucket").filter(f"chunk <= chunk2 AND low2 <= high + {most} AND low <= high2 + {most}").select("fps", "others")
    return found.filter("a IS NOT NULL").select("a", "b").union(near.repartition(spread(fps)).mapInArrow(_of_chunks(most), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Rows (id, fp, component_id): component_id is the smallest id of the class."""
    fp = materialize(with_fingerprint(docs.select(id_col, text_col), text_col, [id_col]), "fingerprints")
    nodes = materialize(fp.groupBy("fp").agg(F.min(id_col).alias("_first")), "simhash-nodes")
    comp = connected_components(links(nodes.select("fp"), most))
    own = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "_first", F.coalesce("component", "fp").alias("_class"))
    own = materialize(own, "simhash-own")
    # written first, so that both sides of the join are plain shuffles: Spark splits a large class only then
    least = materialize(own.groupBy("_class").agg(F.min("_first").alias("component_id")), "simhash-least")
    classes = materialize(own.join(least, "_class").select("fp", "component_id"), "simhash-classes")
    discard(nodes, own, least)
    return fp.join(classes, "fp").select(id_col, "fp", "component_id")


def op10_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
