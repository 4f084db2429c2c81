"""Benchmark decontamination with a generalised suffix automaton over words.

Texts are normalised (A-Z in lower case; words are runs of ASCII letters, digits and all characters from U+0080).  A
window is ``width`` consecutive words of an item; an item with fewer words, but some, is one window.  The automaton
holds all items; a document's words stream through it, which tracks the longest match that ends at each word.  Where
that reaches the width, or a whole short item ends, the words of that window are hit; hit words in a row are a span.

* ``find_spans`` gives the spans, ``flag`` the documents of which hit words are at least ``1 / share``.
* ``remove_spans`` cuts spans from the text that are longer than ``most_words`` words or more than ``1 / share`` of the
  document: from the first byte of a span's first word to the last byte of its last one.

Items are cut into overlapping pieces and dealt by hash into blocks of some ``block_words`` words.  Tasks build a block's
automaton, packed in arrays (most states have one move), so a block is of bounded size whatever the benchmark (README has
the figures).  Documents are scanned once: up to ``BLOCKS_A_SCAN`` blocks are broadcast; of more, a task holds so many at a
time and takes each slice of its documents through all of them, reading the blocks from the shared folder.  Only runs of
words that a block's items know, at least as long as its shortest window, are streamed; others can't match.

Null or empty text has no words.  Items with null text have none either; items with a null id hit words but aren't
counted or listed.  Repeated ids count once, repeated rows are judged alike.  Very long texts stream.  Ties don't arise.  An
empty benchmark hits nothing, an empty table gives no rows.  Input columns named like an added column are replaced by it.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import fresh_path, materialize, open_folder, slices, table, utf8, without

WIDTH, SHARE, MOST_WORDS = 13, 20, 20
BLOCK_WORDS, BLOCKS_A_SCAN, PIECE = 100_000, 8, 4096

#: Letters to lower case, ASCII that isn't a letter or digit to a space, bytes of other characters as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def norm_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences.

    Per state, in arrays: longest length, suffix link, one move, and where its windows begin in two more arrays, of their
    lengths and items; further moves in one dictionary by state and word.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes], bool]], width: int = WIDTH):
        """items: (id, words, whether these are a whole item of fewer words than the width)."""
        self.vocab: dict[bytes, int] = {}
        length, link, moves = [0], [-1], [{}]
        self._parts = length, link, moves
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in seq] for _, seq, _ in items]
        for ids in seqs:
            last = 0
            for w in ids:
                last = self._add(last, w)
        del self._parts
        self.length, self.link = array("i", length), array("i", link)
        self.word, self.to = array("i", [-1]) * len(link), array("i", [-1]) * len(link)
        self.more: dict[int, int] = {}
        for state, out in enumerate(moves):
            for k, (w, to) in enumerate(out.items()):
                if k:
                    self.more[state * len(self.vocab) + w] = to
                else:
                    self.word[state], self.to[state] = w, to
        windows: set[tuple[int, int, int]] = set()  # (state, window length, place of the item's id)
        self.ids = list(dict.fromkeys(item for item, _, _ in items))
        place = {item: k for k, item in enumerate(self.ids)}
        self.shortest = width
        for (item, _, short), ids in zip(items, seqs):  # states are final now: note where each item's windows end
            state, n = 0, 0
            for w in ids:
                state, n = self.step(state, n, w)
                size = len(ids) if short else width
                if n >= size:
                    windows.add((self._of(state, size), size, place[item]))
                    self.shortest = min(self.shortest, size)
        # nearest state on the suffix path, itself included, at which some window ends
        ends = np.array(sorted(windows), np.int32).reshape(-1, 3)
        self.first = array("i", np.searchsorted(ends[:, 0], np.arange(len(link) + 1)).astype(np.int32).tobytes())  # a state's windows: from its place here to the next state's
        self.size, self.item = array("i", ends[:, 1].tobytes()), array("i", ends[:, 2].tobytes())
        self.near = array("i", [-1]) * len(link)
        for s in sorted(range(len(link)), key=self.length.__getitem__):
            self.near[s] = s if self.first[s] < self.first[s + 1] else self.near[self.link[s]] if self.link[s] >= 0 else -1

    def _new(self, longest: int, to: int, out: dict) -> int:
        length, link, moves = self._parts
        length.append(longest)
        link.append(to)
        moves.append(out)
        return len(length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A state for the strings of ``q`` that are at most one longer than ``p``'s longest."""
        length, link, moves = self._parts
        clone = self._new(length[p] + 1, link[q], dict(moves[q]))
        link[q] = clone
        while p >= 0 and moves[p].get(w) == q:
            moves[p][w] = clone
            p = link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        length, link, moves = self._parts
        if (q := moves[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = self._new(length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        size = len(self.vocab)
        while True:
            to = self.to[state] if self.word[state] == w else self.more.get(state * size + w, -1)
            if to >= 0:
                return to, n + 1
            if not state:
                return 0, 0
            state = self.link[state]
            n = self.length[state]

    def _of(self, state: int, n: int) -> int:
        """The state that holds the suffix of length ``n``."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def match(self, ids: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Spans (start, end) of windows in a run of known words, and the items they belong to."""
        spans, items, state, n = [], set(), 0, 0
        for at, w in enumerate(ids):
            state, n = self.step(state, n, w)
            s, longest = self.near[state], 0
            while s >= 0:
                for e in range(self.first[s], self.first[s + 1]):
                    if self.size[e] <= n:
                        longest = max(longest, self.size[e])
                        items.add(self.ids[self.item[e]])
                s = self.near[self.link[s]] if self.link[s] >= 0 else -1
            if longest:
                spans.append((at + 1 - longest, at + 1))
        return spans, items

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """As ``match``, for the words of a whole text."""
        ids = np.fromiter((self.vocab.get(w, -1) for w in ws), np.int64, len(ws))
        spans, items = [], set()
        for a, b in _known_runs(ids >= 0, self.shortest):
            found, mine = self.match(ids[a:b].tolist())
            spans += [(a + x, a + y) for x, y in found]
            items |= mine
        return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _known_runs(known: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    runs = edge.reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= least].tolist()


def automata(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_words: int) -> tuple[str, int]:
    """The folder of the automata by block, in the shared folder, and the number of blocks; tasks build them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch.column("t"))):
                ws = norm_words(text)
                for a in range(0, max(len(ws) - width + 1, min(len(ws), 1)), PIECE):
                    rows.append((item, b" ".join(part := ws[a : a + PIECE + width - 1]), len(part), len(ws) < width))
            item, words, n, short = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(short, pa.bool_())], names=["item", "words", "n", "short"])

    pieces = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t")).mapInArrow(cut, "item string, words binary, n long, short boolean")
    pieces = materialize(pieces, "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // block_words)

    def build(rows: pa.Table) -> pa.Table:
        items = [(i, w.split(b" "), s) for i, w, s in zip(*(rows.column(c).to_pylist() for c in ("item", "words", "short")))]
        made = pickle.dumps(Automaton(items, width), protocol=5)
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "automaton": pa.array([made], pa.binary())})

    # several items may be equal: the item's id takes part in the hash
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(n_blocks, 1))))
    made = dealt.groupBy("block").applyInArrow(build, "block long, automaton binary")
    folder = fresh_path(benchmark.sparkSession, "automata")
    made.write.partitionBy("block").parquet(folder)  # a folder for each block, that tasks can open
    return folder, n_blocks


def _opened(folder: str, blocks: range) -> list[Automaton]:
    """Automata of some blocks from the shared folder; a block that no item fell into has none."""
    out = []
    for k in blocks:
        fs, root = open_folder(f"{folder}/block={k}")
        for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
            if f.path.endswith(".parquet"):
                out += [pickle.loads(x) for x in pq.read_table(f.path, filesystem=fs, columns=["automaton"]).column(0).to_pylist()]
    return out


FOUND = "n_words long, starts array<long>, ends array<long>, items array<string>"


def _scan(groups: list, load, text_col: str, names: list[str], into: str):
    """Adds column ``into`` (of FOUND); ``load`` gives a group's automata, which are kept if there is one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = load(groups[0]) if len(groups) == 1 else None
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        for batch in slices(batches, text_col):
            texts = utf8(batch.column(text_col))
            sizes, spans, who = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for g in groups:
                autos = load(g) if kept is None else kept
                for k, text in enumerate(texts):
                    ws = norm_words(text)
                    sizes[k] = len(ws)
                    for auto in autos:
                        found, mine = auto.find(ws)
                        spans[k] += found
                        who[k] |= mine
                    spans[k] = merge(spans[k])
            rows = [(n, [a for a, _ in x], [b for _, b in x], sorted(i for i in w if i is not None)) for n, x, w in zip(sizes, spans, who)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            struct = pa.StructArray.from_arrays(cols, names=["n_words", "starts", "ends", "items"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), struct], names=[*names, into])

    return run


def find_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS, blocks_a_scan: int = BLOCKS_A_SCAN) -> DataFrame:
    """``docs`` with n_words, the hit spans in words (starts, ends; merged) and items (sorted strings)."""
    added = StructType.fromDDL(FOUND)
    docs = without(docs, *added.names)
    names, spark = docs.columns, docs.sparkSession
    into = "_found"
    while into in {n.lower() for n in names}:
        into += "_"
    schema = StructType([*docs.schema.fields, StructField(into, added)])
    folder, n_blocks = automata(benchmark, item_id, item_text, width, block_words)
    groups = [range(a, min(a + blocks_a_scan, n_blocks)) for a in range(0, n_blocks, blocks_a_scan)] or [range(0)]
    if len(groups) == 1:
        rows = spark.read.schema("automaton binary, block long").parquet(folder).select("automaton").collect() if n_blocks else []
        some = spark.sparkContext.broadcast([bytes(r.automaton) for r in rows])  # blocks_a_scan blocks of bounded size
        load = lambda _: [pickle.loads(x) for x in some.value]
    else:
        load = lambda blocks: _opened(folder, blocks)
    out = docs.mapInArrow(_scan(groups, load, text_col, names, into), schema)
    return out.select(*(F.col(f"`{c}`") for c in names), f"{into}.*")


def flag(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds n_hit, n_items and contaminated to what ``find_spans`` returns."""
    found = without(found, "n_hit", "n_items", "contaminated")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")}).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove_spans(found: DataFrame, text_col: str = "text", most_words: int = MOST_WORDS, share: int = SHARE) -> DataFrame:
    """What ``find_spans`` returns, its text without the spans beyond a limit; adds n_cut (words cut)."""
    found = without(found, "n_cut")
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, cut = [], []
            for text, valid, n, starts, ends in zip(utf8(batch.column(text_col)), batch.column(text_col).is_valid().to_pylist(), *(batch.column(c).to_pylist() for c in ("n_words", "starts", "ends"))):
                gone = [(a, b) for a, b in zip(starts, ends) if b - a > most_words or share * (b - a) > n]
                cut.append(sum(b - a for a, b in gone))
                if gone:
                    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
                    edges = [0, *(x for a, b in gone for x in (places[a][0], places[b - 1][1])), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(text if valid else None)
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.int64())], names=[*names, "n_cut"])

    return found.mapInArrow(run, StructType([*found.schema.fields, *StructType.fromDDL("n_cut long").fields]))


def op9_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = flag(remove_spans(find_spans(docs, table(spark, sf_dir, "benchmark"))))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_cut")


SQL = r"""
WITH b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS k FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), dw AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS k FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), cut AS (
  SELECT doc_id, sum(n) FILTER (n > 20 OR 20 * n > n_words) AS n_cut FROM (
    SELECT doc_id, any_value(n_words) AS n_words, count(*) AS n FROM (
      SELECT doc_id, len(w) AS n_words, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island
      FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) JOIN d USING (doc_id)
    ) GROUP BY doc_id, island
  ) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated, coalesce(n_cut, 0)::BIGINT AS n_cut
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
