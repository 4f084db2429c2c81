"""Bit arrays over 64-bit hashes that tasks fill, merge by segment and read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

MOST_BITS = 1 << 28

SEGMENT_BYTES = 1 << 16


def size_for(n: int, per_item: int = 8, most_bits: int = 1 << 30) -> int:
    """Bits, a power of two: ``per_item`` for each of ``n`` items, at least one segment and at most ``most_bits``."""
    bits = SEGMENT_BYTES * 8
    while bits < n * per_item and bits < most_bits:
        bits *= 2
    return bits


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places for each hash."""
    h = h.astype(np.uint64, copy=False)
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask


def put(filt: np.ndarray, h: np.ndarray) -> None:
    for p in places(h, filt.size * 8):
        np.bitwise_or.at(filt, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def has(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(h.size, bool)
    for p in places(h, filt.size * 8):
        found &= (filt[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def key_filter(keys: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter of a long column, built in tasks and merged by segment; ``most_bits`` / 8 bytes at most."""
    bits = size_for(keys.count(), 12, most_bits)
    name = keys.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            put(filt, batch.column(name).to_numpy().view(np.uint64))
        for k in range(0, filt.size, SEGMENT_BYTES):
            if (part := filt[k : k + SEGMENT_BYTES]).any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k // SEGMENT_BYTES], pa.int64()), "bits": pa.array([part.tobytes()], pa.binary())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bitset = None, None
        out = lambda: pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int64()), "bits": pa.array([bitset.tobytes()], pa.binary())})
        for batch in batches:
            for s, b in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist()):
                if s != at:
                    if at is not None:
                        yield out()
                    at, bitset = s, np.frombuffer(b, np.uint8).copy()
                else:
                    bitset |= np.frombuffer(b, np.uint8)
        if at is not None:
            yield out()

    ddl, filt = "segment long, bits binary", np.zeros(bits // 8, np.uint8)
    for row in keys.mapInArrow(fill, ddl).repartition(spread(keys), "segment").sortWithinPartitions("segment").mapInArrow(fold, ddl).collect():
        filt[row.segment * SEGMENT_BYTES : (row.segment + 1) * SEGMENT_BYTES] = np.frombuffer(row.bits, np.uint8)
    return filt


def having(df: DataFrame, key: str, filt: Broadcast, wanted: bool) -> DataFrame:
    """The rows whose long column ``key`` the filter has (or doesn't have; nulls are in no filter), without that column."""
    names = [c for c in df.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key)
            hit = has(filt.value, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & keys.is_valid().to_numpy(zero_copy_only=False)
            yield batch.select(names).filter(pa.array(hit == wanted))

    return df.mapInArrow(run, df.drop(key).schema)


def marked(df: DataFrame, key: str, filt: Broadcast, name: str) -> DataFrame:
    """``df`` with the boolean column ``name`` in place of the long ``key``: whether the filter has it (nulls are in no filter).

    Only the key goes to Python, so rows may be of any length.
    """

    @F.arrow_udf("boolean")
    def hit(keys: pa.Array) -> pa.Array:
        return pa.array(has(filt.value, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & keys.is_valid().to_numpy(zero_copy_only=False))

    return df.withColumn(name, hit(key)).drop(key)
