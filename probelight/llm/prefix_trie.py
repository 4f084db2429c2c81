"""The trie of conversation prefixes: which conversations share which first turns, and what caching them would save.

1. A turn is the MD5 of its role and text (16 bytes; texts don't travel).  Conversations are arrays of turns.
2. Conversations in lexicographic order of their turns, then by id, are dealt out by range: a part, and in it each block of
   at most ``BLOCK`` turns, is a shard that holds whole subtrees but for the paths to its first and last conversation.
   A hot first turn, and copies of one conversation, are split like everything else.
3. A shard is a double-array trie: turns get dense ids, BASE and CHECK are packed so that the child of node s by turn c is
   BASE[s] + c, where CHECK says s.  All conversations of the block walk through it at once, level by level; sums go up
   from child to parent along CHECK.
4. Nodes off the two border paths are whole and never shuffled again.  Those on them, some per shard, are merged over all
   shards by the digest of their prefix; subtree sums then go to all their merged ancestors, and the whole nodes below
   them get their parent's id in a join.

Per conversation the turns must fit into a task (20 bytes each), and the border paths' digests cost the square of their
turns.  Null role and text are empty; turns are in order of ``turn``, null first, ties by role and digest; repeated rows
are turns of their own; rows without a conversation id belong to no conversation and are left out.  An empty table has no
root.  Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, materialize, spread, table

#: Turns of a shard's trie.
BLOCK = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each with its digest and its count of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    place = [F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", digest.alias("key")]
    words = F.regexp_count("text", F.lit(WORD_GAP.replace("[", "[^"))).alias("words")
    source = F.col("conv_id") - F.col("conv_id") % 20  # dealt by what ``rebuild`` joins on: one shuffle for both
    dealt = t.select(source.alias("source"), "conv_id", F.struct(*place, words).alias("t")).repartition(spread(t), "source")
    return dealt.groupBy("source", "conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("turns"))


def rebuild(convs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 20, h = crc32(c) % 4."""
    heads = convs.filter("conv_id = source").select("source", F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(convs.schema["turns"].dataType))
    return convs.join(heads, "source", "left").select("conv_id", F.concat(head, own).alias("turns"))


class DoubleArray:
    """A trie over dense ids: the child of node s by id c is BASE[s] + c, if CHECK there is s.  The root is node 0."""

    TRIES = 64

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """``codes``: the ids of all sequences, the k-th from ``starts[k]``; sequences are distinct and sorted by prefix."""
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0], self.end = 0, 1
        node = np.zeros(len(sizes), np.int64)
        for d in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > d)
            s, c = node[live], codes[starts[live] + d]
            first = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]  # an equal prefix stands in neighbours
            self._pack(s[first], c[first])
            node[live] = self.base[s] + c

    def _grow(self, least: int) -> None:
        if least > len(self.check):
            more = max(least, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _pack(self, parent: np.ndarray, code: np.ndarray) -> None:
        """Places the children of a level: those with siblings first, only children then fill the holes."""
        cuts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                self._place(parent[a], np.sort(code[a:b]))
        only = cuts[:-1][np.diff(cuts) == 1]
        free = np.flatnonzero(self.check[: self.end] < 0)[: len(only)]
        if len(free) < len(only):
            self._grow(self.end + len(only))
            free = np.r_[free, np.arange(self.end, self.end + len(only) - len(free))]
        self.check[free], self.base[parent[only]] = parent[only], free - code[only]
        self.end = max(self.end, int(free.max(initial=0)) + 1)

    def _place(self, parent: int, codes: np.ndarray) -> None:
        holes = np.flatnonzero(self.check[: self.end] < 0)[: self.TRIES]
        for first in (*holes.tolist(), self.end):
            at = first + codes - codes[0]
            self._grow(int(at[-1]) + 1)
            if (self.check[at] < 0).all():
                break
        self.check[at], self.base[parent] = parent, first - codes[0]
        self.end = max(self.end, int(at[-1]) + 1)

    def walk(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children of nodes by ids; -1 where there is none."""
        at = self.base[node] + code
        ok = (at > 0) & (at < len(self.check))
        return np.where(ok & (self.check[np.where(ok, at, 0)] == node), at, -1)


SHARD = (
    "border boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "parent_key binary, key binary, path array<binary>, words long, first_end long, ends binary"
)
_TYPES = [pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in SHARD.split(", ")]


def _prefix_keys(turns: list[bytes]) -> list[bytes]:
    """The digests of a sequence's prefixes, the empty one first."""
    out = [b""]
    for t in turns:
        out.append(hashlib.md5(out[-1] + t).digest())
    return out


def _shard(ids: np.ndarray, keys: pa.Array, size: np.ndarray, words: np.ndarray) -> list[pa.Array]:
    """The columns of a block's nodes: ids of conversations, all their turns' keys, how many each has, and words by turn."""
    start = np.cumsum(size) - size
    row, place = np.repeat(np.arange(len(ids)), size), np.arange(len(words)) - np.repeat(start, size)
    by_level = np.lexsort((row, place))
    codes = np.empty(len(words), np.int64)
    codes[by_level] = keys.take(pa.array(by_level)).dictionary_encode().indices.to_numpy() + 1  # siblings get ids that lie close
    flat = codes.tobytes()
    seqs = [flat[8 * a : 8 * (a + n)] for a, n in zip(start.tolist(), size.tolist())]
    cut = np.array([k for k in range(len(seqs)) if not k or seqs[k] != seqs[k - 1]], np.int64)  # copies stand together
    n_same = np.diff(np.r_[cut, len(ids)])
    start, size, least = start[cut], size[cut], ids[cut]
    trie = DoubleArray(codes, start, size)

    n = trie.end
    count, low, depth, word = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
    node, levels = np.zeros(len(cut), np.int64), [np.zeros(1, np.int64)]
    paths = {0: [0], len(cut) - 1: [0]}
    count[0], low[0] = n_same.sum(), least.min()
    for d in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > d)
        at = trie.walk(node[live], codes[start[live] + d])
        node[live] = at
        np.add.at(count, at, n_same[live])
        np.minimum.at(low, at, least[live])
        depth[at], word[at] = d + 1, words[start[live] + d]
        levels.append(np.unique(at))
        for k, p in paths.items():
            if size[k] > d:
                p.append(int(node[k]))
    border, key, path_of = np.zeros(n, bool), {}, {}
    for k, p in paths.items():
        chain = _prefix_keys(keys.slice(start[k], size[k]).to_pylist())
        for i, (x, y) in enumerate(zip(p, chain)):
            key[x], path_of[x], border[x] = y, chain[:i], True
    ends = dict(zip(node.tolist(), range(len(cut))))  # the sequence that ends at a node
    kids, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), (count - 1) * word
    saved[border] = 0  # what border nodes add themselves is known after the merge
    for level in reversed(levels):
        leaves[level] += (kids[level] == 0) & ~border[level]
        if level[0]:
            up, whole = trie.check[level], ~border[level]
            np.add.at(kids, up[whole], 1)
            np.add.at(leaves, up, leaves[level])
            np.add.at(saved, up, saved[level])
    nodes = np.concatenate(levels)
    up = trie.check[nodes]
    text = lambda k: ",".join(map(str, ids[cut[k] : cut[k] + n_same[k]].tolist())).encode()
    on, at_border = border[nodes].tolist(), border[up].tolist()
    rows = list(zip(nodes.tolist(), up.tolist(), on, at_border))
    end = [ends.get(x) for x in nodes.tolist()]
    return [
        pa.array(on), pa.array(low[nodes]), pa.array(depth[nodes]),
        pa.array([None if b or u else int(low[y]) for x, y, b, u in rows], pa.int64()), pa.array(count[nodes]), pa.array(kids[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
        pa.array([None if b else NO_ENDS if k is None else hashlib.sha256(text(k)).hexdigest() for b, k in zip(on, end)], pa.string()),
        pa.array([key[y] if u and x else None for x, y, b, u in rows], pa.binary()), pa.array([key[x] if b else None for x, y, b, u in rows], pa.binary()),
        pa.array([path_of[x] if b else None for x, y, b, u in rows], pa.list_(pa.binary())), pa.array(word[nodes]),
        pa.array([int(least[k]) if b and k is not None else None for b, k in zip(on, end)], pa.int64()), pa.array([text(k) if b and k is not None else None for b, k in zip(on, end)], pa.binary()),
    ]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = np.diff(batch.column("keys").offsets.to_numpy()).astype(np.int64)
        block = np.cumsum(every) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                cols = _shard(part.column("conv_id").to_numpy(), part.column("keys").flatten(), every[a:b], part.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of parts of lists that come in order, a key's together: the hash runs on from part to part."""
    now, h = None, None
    for batch in batches:
        done = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k == now:
                h.update(b",")
            else:
                if now is not None:
                    done.append((now, h.hexdigest()))
                now, h = k, hashlib.sha256()
            h.update(text)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([y for _, y in done], pa.string())], names=["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends_sha256"])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv_id, turns): see the contract of ``op12_prefix_trie``."""
    flat = convs.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"))
    flat = materialize(flat, "trie-turns")  # read twice: for the ranges' bounds, and to be dealt out
    dealt = flat.repartitionByRange(spread(flat), "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    found = materialize(dealt.mapInArrow(_shards, SHARD), "trie-nodes")

    border = found.filter("border")
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("depth", "parent_key", "path", "words")]
    shared = materialize(border.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *total, *same), "trie-shared")
    parts = border.filter("ends IS NOT NULL").select("key", "first_end", "ends").repartition(spread(flat), "key").sortWithinPartitions("key", "first_end")
    hashes = parts.mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    kids = shared.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_kids"))
    own = shared.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).drop("_kids")
    adds = own.select(F.explode(F.concat("path", F.array("key"))).alias("key"), (F.col("n_children") == 0).cast("long").alias("_l"), ((F.col("n_convs") - 1) * F.col("words")).alias("_s"))
    below = adds.groupBy("key").agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
    ids = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    merged = own.join(below, "key").join(hashes, "key", "left").join(ids, "parent_key", "left").select(
        "conv_id", "depth", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("_l")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("_s")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    whole = found.filter("NOT border")
    below_border = whole.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(ids.withColumnRenamed("_parent", "parent_conv_id"), "parent_key")
    return whole.filter("parent_key IS NULL").select(*NODE).unionByName(below_border.select(*NODE)).unionByName(merged.select(*NODE))


def op12_prefix_trie(spark, sf_dir):
    return nodes(rebuild(conversations(table(spark, sf_dir, "conversations"))))


#: CRC-32 of a string's bytes, by its polynomial bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, 8 * octet_length(encode({x}))), lambda i: i::UBIGINT)),
  lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(encode({x})), (i // 4)::INT + 1, 2))::UBIGINT ELSE 0::UBIGINT END) >> 1,
                   CASE WHEN (xor(a, CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(encode({x})), (i // 4)::INT + 1, 2))::UBIGINT ELSE 0::UBIGINT END) & 1) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT)"""
SQL = f"""
WITH t AS (
  SELECT conv_id AS c, md5(octet_length(encode(r))::VARCHAR || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w, turn, r
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT c, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, r, k) AS turns FROM t GROUP BY c),
h AS (SELECT *, ({_CRC.format(x="c::VARCHAR")} % 4)::BIGINT AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(s.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o s ON s.c = h.c - h.c % 20),
p AS (SELECT c, d, len(turns) AS n, list_transform(turns[1:d], lambda q: q.k) AS path, list_transform(turns[1:d - 1], lambda q: q.k) AS up, CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (SELECT path, d AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT up, depth - 1 AS depth, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON n.path = k.up AND n.depth = k.depth),
s AS (SELECT a, len(a) AS depth, sum((kids = 0)::BIGINT)::BIGINT AS leaves, sum((n_convs - 1) * w)::BIGINT AS saved FROM (SELECT *, path[1:unnest(range(0, depth + 1))] AS a FROM m) GROUP BY a)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.a = m.path LEFT JOIN m u ON m.depth > 0 AND u.path = m.up"""
