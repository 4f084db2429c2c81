"""Best-fit packing of tokenised documents into sequences of at most ``size`` tokens.

1. Tokens: a document's ids and one end id; longer ones are cut into pieces of ``size``, the first may be shorter.
   The scan keeps per piece only its place, length and CRC, and numbers the pieces of each length within its task.
2. Documents and gaps in order of size form runs of equal length: at most ``size`` classes, so their table has a fixed
   bound whatever the corpus.  Supersteps take the classes from long to short: a sweep finds each class's successor,
   the smallest gap that holds it; the first ranks of the class win the gaps, the others go on to the next gap or open
   new sequences; gaps are updated; and so on until no class is left.  A superstep is best fit for all its documents.
3. Ranks within a class are prefix sums over the tasks' counts; each piece meets its superstep's run by rank.

Null or empty text is the end id alone.  Repeated rows and ids are packed as rows of their own; null ids stay null.
Empty input gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table

SIZE, END = 1024, 2


class Encoder:
    """Ids of ``tokenizers`` as little-endian 32-bit bytes, with a memory of the pieces between spaces.

    Before a space that other text follows there is always a break between pre-tokens, so what stands between such
    spaces can be encoded alone.  Texts with other runs of space, or with a special token's name, are encoded whole; the
    latter and texts with a run of ``LONG_RUN`` white space by ``tokenizers``, as the stack of ``tiktoken`` overflows.
    """

    MOST = 200_000
    LONG_RUN = 100_000
    LONG = re.compile(r"\s{%d}" % LONG_RUN)

    def __init__(self, vocabulary: str):
        import json

        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary.replace(".json", ".tiktoken"), "rb"))}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.new, self.old = {}, {}

    @functools.cached_property
    def whole(self):
        """The library's encoder; few texts need it, so most workers never hold it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def _piece(self, key: str) -> bytes:
        if not key or key[0].isspace():
            raise KeyError(key)
        got = self.old.get(key)
        if got is None:
            got = np.array(self.plain.encode_ordinary(" " + key), dtype="<u4").tobytes()
        if len(self.new) >= self.MOST:
            self.old, self.new = self.new, {}
        self.new[key] = got
        return got

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or (len(text) >= self.LONG_RUN and self.LONG.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        try:
            if not head:
                raise KeyError(head)
            found = list(map(self.new.get, rest, repeat(None)))
            if None in found:
                found = [x if x is not None else self._piece(k) for k, x in zip(rest, found)]
            return np.array(self.plain.encode_ordinary(head), dtype="<u4").tobytes() + b"".join(found)
        except KeyError:
            return np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


PIECE = "piece int, start long, length long, ids_crc32 long, part long, ord long"


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % size or size
    return [(0, min(n, first)), *((a, size) for a in range(first, n, size))]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32; part and ord number the pieces of a length by task."""
    end_bytes = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), encoder(vocabulary)
        for batch in slices(batches, text_col, 4 << 20):
            ids, rows = [], []
            for i, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()):
                raw = enc.encode(text or "") + end_bytes
                for k, (a, n) in enumerate(cut(len(raw) // 4, size)):
                    ids.append(i)
                    rows.append((k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), seen[n]))
                    seen[n] += 1
            k, a, n, crc, o = (np.array(x, dtype=np.int64) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k).cast(pa.int32()), pa.array(a), pa.array(n), pa.array(crc), pa.array(np.full(len(ids), part)), pa.array(o)], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "ord"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col)).mapInArrow(run, f"`{id_col}` long, {PIECE}")


def supersteps(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int]]:
    """Best fit over classes: runs (length, first rank, first sequence, offset), each up to the next run's first rank."""
    gaps: list[int] = []  # sorted gaps with open runs
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number)
    plan, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)  # the successor sweep
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                gap, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = gap // length  # so many of this class fill one gap before the next gap is the best
            full, rest = divmod(min(left, n * each), each)
            for k in range(each if full else 0):
                plan.append((length, rank, first, size - gap + k * length))
                rank += full
            put(gap - each * length, first, full)
            for k in range(rest):
                plan.append((length, rank, first + full, size - gap + k * length))
                rank += 1
            if rest:
                put(gap - rest * length, first + full, 1)
            put(gap, first + full + bool(rest), n - full - bool(rest))
            left = counts[length] - rank
    return plan


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """``pieces`` with sequence_id and offset, without gaps."""
    cuts = materialize(pieces(docs, vocabulary, id_col, text_col, size, end), "pieces")
    by_task = materialize(cuts.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cuts.join(by_task.select("part", "length", before.alias("_before")), ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("ord"))
    plan = np.array(sorted(supersteps(counts, size)) or np.empty((0, 4)), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    keep = [id_col, "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, offset = shared.value.T
        key = length << 48 | rank
        for batch in batches:
            r = batch.column("_rank").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() << 48 | r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(first[at] + r - rank[at]), pa.array(offset[at])], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "_rank").mapInArrow(place, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
