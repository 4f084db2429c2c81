"""Toxicity by a classifier chain.

Categories are label columns, predicted one after the other; each linear model sees the words and the probabilities of the
categories before it.  For training those are out-of-fold predictions, so that later models learn from probabilities as
good as they will get.

* Training rows: at most ``MOST_ROWS`` labelled documents of each combination of labels, those with the least hash of
  their id.  The bound is a parameter; scoring covers all rows.
* Folds go by the least hash of a document's 3-word shingles, so near-copies tend to share a fold and others don't.
* Words: one aggregation counts them by category and fold.  For each fold's models words are chosen from the other folds
  alone, for the final models from all.  Kept are at most ``MOST_WORDS``, an equal share for each category, that are much
  more frequent in one class and are so in several folds (a word from copies of one document isn't).
* Scoring: one scan of whole texts, no shuffle; the model is a small dictionary sent with the task.

The last category decides ``toxic``, at the threshold with the best F1 of out-of-fold probabilities.  Ties among words go by
the word, among thresholds to the middle one.  Null or empty text has no words; very long texts are read whole.  Labels
with nulls are left out; of repeated labels any counts.  A category without positive or negative labels has probability
zero.  Rows with null or repeated ids are scored like others.  Input columns named like an added column are replaced by
it.  An empty table gives no rows, and no labels a model that calls nothing toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .common import free_name, materialize, slices, table, utf8, without
from .decontaminate import norm_words

MOST_ROWS, MOST_WORDS, FOLDS, L2, STEM = 2500, 256, 5, 1.0, 6
#: Label columns in order of the chain.
CATEGORIES = ("quality", "toxic")


def stem(word: bytes) -> bytes:
    """^ and the first characters, which stand for a family of words."""
    return b"^" + (word[:STEM] if word.isascii() else word.decode(errors="ignore")[:STEM].encode())


def tokens(text: bytes) -> list[bytes]:
    """The normalised words, and the stems of the longer ones."""
    ws = norm_words(text)
    return ws + [stem(w) for w in ws if len(w) > STEM]


def fold_of(ws: list[bytes]) -> int:
    return min((xxhash.xxh3_64_intdigest(b" ".join(ws[k : k + 3])) for k in range(max(len(ws) - 2, 1))), default=0) % FOLDS


class Chain:
    """A fitted chain.  words: place of each feature word; models: weights and bias of each category, None if it has none."""

    def __init__(self, categories: Sequence[str], words: dict[bytes, int], models: list[tuple[np.ndarray, float] | None], cut: float):
        self.categories, self.words, self.models, self.cut = tuple(categories), words, models, cut

    def features(self, text: bytes) -> Counter:
        get = self.words.get
        return Counter(k for w in tokens(text) if (k := get(w)) is not None)

    def predict(self, found: Counter) -> list[float]:
        """Probabilities of the categories, each fed to the next model."""
        at = np.fromiter(found, np.int64, len(found))
        x = np.log1p(np.fromiter(found.values(), np.float64, len(found)))
        out: list[float] = []
        for model in self.models:
            if model is None:
                out.append(0.0)
                continue
            w, b = model
            out.append(float(linear.sigmoid(np.array(w[at] @ x + b + sum(p * v for p, v in zip(out, w[len(self.words) :]))))))
        return out


def sample(labels: DataFrame, id_col: str, categories: Sequence[str], most: int) -> DataFrame:
    """(id, y): at most ``most`` ids of each combination of labels (y is an array of 0 and 1), by least hash."""
    given = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (id_col, *categories)))
    y = F.array(*(F.max((F.col(c) > 0).cast("int")) for c in categories))
    rows = labels.filter(given).groupBy(F.col(id_col).cast("long").alias("id")).agg(y.alias("y"))
    kinds = [F.array(*(F.lit(k >> n & 1) for n in range(len(categories)))) for k in range(1 << len(categories))]
    return reduce(DataFrame.union, (rows.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in kinds))


def bags(docs: DataFrame, text_col: str) -> DataFrame:
    """(id, y, fold, words, counts) of rows (id, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            bag = [Counter(tokens(t)) for t in utf8(batch.column(text_col))]
            fold = [fold_of(norm_words(t)) for t in utf8(batch.column(text_col))]
            names = [[w.decode("latin-1") for w in b] for b in bag]  # bytes as characters, one for one
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(fold, pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array([list(b.values()) for b in bag], pa.list_(pa.int32()))], names=["id", "y", "fold", "words", "counts"])

    return docs.mapInArrow(run, "id long, y array<int>, fold int, words array<string>, counts array<int>")


def word_counts(rows: DataFrame, n_categories: int) -> DataFrame:
    """(w, cells): for each word, by fold the documents with it and those of each category."""
    by_fold = rows.select("y", "fold", F.explode("words").alias("w")).groupBy("w", "fold").agg(F.array(F.count("*"), *(F.sum(F.get("y", k)) for k in range(n_categories))).alias("cell"))
    return by_fold.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("fold", "cell"))).alias("cells"))


def choose_words(counts: DataFrame, totals: dict[int, list[int]], sets: Sequence[tuple[int, int | None]], most: int) -> list[list[str]]:
    """For each (category, fold left out or None), at most ``most`` words by how much likelier they are in one class of the category."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    cell = lambda f, k: F.coalesce(F.get(F.element_at("cells", F.lit(f)), k), F.lit(0))
    scored = []
    for number, (category, left_out) in enumerate(sets):
        folds = [f for f in range(FOLDS) if f != left_out]
        here = [totals[f] for f in folds if f in totals]
        pos = max(sum(t[category + 1] for t in here), 1)
        neg = max(sum(t[0] for t in here) - pos, 1)
        p, q = [cell(f, category + 1) for f in folds], [cell(f, 0) - cell(f, category + 1) for f in folds]
        up = add([(a * neg > 2 * b * pos).cast("int") for a, b in zip(p, q)])
        down = add([(2 * a * neg < b * pos).cast("int") for a, b in zip(p, q)])
        odds = F.log((add(p) + 0.5) / (pos + 1.0)) - F.log((add(q) + 0.5) / (neg + 1.0))
        z = F.abs(odds / F.sqrt(1 / (add(p) + 0.5) + 1 / (add(q) + 0.5)))
        kept = (add(p) + add(q) >= 5) & (F.greatest(up, down) >= len(folds) - 1)
        scored.append(F.when(kept, F.struct(F.lit(number).alias("number"), z.alias("z"))))
    rows = counts.select("w", F.explode(F.array_compact(F.array(*scored))).alias("s")).select("w", "s.number", "s.z")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("z"), "w"))
    out: list[list[str]] = [[] for _ in sets]
    for r in rows.withColumn("place", place).filter(F.col("place") <= most).orderBy("number", "place").collect():  # most words a set
        out[r.number].append(r.w)
    return out


def _numbered(number: dict[str, int]):
    """Rows of ``bags`` with the numbers and counts of the words that have a number, at most (FOLDS + 1) * most_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(number[w], n) for w, n in zip(ws, ns) if w in number] for ws, ns in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist())]
            lists = [pa.array([[x[k] for x in r] for r in rows], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "y", "fold")), *lists], names=["id", "y", "fold", "w", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: Sequence[str] = CATEGORIES, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, fed: bool = True) -> Chain:
    """The chain; without ``fed`` its models don't see each other, for comparison."""
    ids = materialize(sample(labels, id_col, categories, most_rows), "labelled")
    mine = free_name(docs, "_id")
    joined = docs.select(F.col(id_col).cast("long").alias(mine), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col(mine) == F.col("id"))  # most_rows ids a combination
    rows = materialize(bags(joined.select("id", "y", "text"), "text"), "bags")
    counts = materialize(word_counts(rows, len(categories)), "word-counts")
    totals = {r.fold: [r.n, *r.y] for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("y", k)) for k in range(len(categories)))).alias("y")).collect()}
    lots = (*range(FOLDS), None)
    found = choose_words(counts, totals, [(c, f) for f in lots for c in range(len(categories))], max(most_words // len(categories), 1))
    chosen = [list(dict.fromkeys(w for ws in found[k : k + len(categories)] for w in ws)) for k in range(0, len(found), len(categories))]
    number = {w: k for k, w in enumerate(sorted({w for ws in chosen for w in ws}))}
    got = rows.mapInArrow(_numbered(number), "id long, y array<int>, fold int, w array<int>, n array<int>").orderBy("id").collect()  # bounded by most_rows and these words
    y, fold = np.array([r.y for r in got], float).reshape(len(got), len(categories)), np.array([r.fold for r in got])
    every = np.zeros((len(got), len(number)), np.float32)
    for k, r in enumerate(got):
        every[k, np.array(r.w, np.int64)] = np.log1p(r.n)
    of_words = lambda ws: every[:, [number[w] for w in ws]].astype(float)
    words, whole = {w.encode("latin-1"): k for k, w in enumerate(chosen[-1])}, of_words(chosen[-1])
    models: list[tuple[np.ndarray, float] | None] = []
    feed = np.zeros((len(got), 0))
    for c in range(len(categories)):
        t = y[:, c]
        oof = np.zeros(len(got))
        for f in range(FOLDS):
            there = fold != f
            if len(got) and t[there].size and t[there].min() < t[there].max() and (~there).any():
                x = of_words(chosen[f])
                x = np.column_stack((x, feed)) if fed else x
                w, b = linear.logistic(x[there], t[there], L2)
                oof[~there] = linear.sigmoid(x[~there] @ w + b)
        if not t.size or t.min() == t.max() or not words:
            models.append(None)
        else:
            w, b = linear.logistic(np.column_stack((whole, feed)) if fed else whole, t, L2)
            models.append((np.concatenate((w, np.zeros(len(words) + c - w.size))), b))
        feed = np.column_stack((feed, oof))
    cut = best_cut(feed[:, -1], y[:, -1]) if models[-1] is not None else 1.0
    return Chain(categories, words, models, cut)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 of out-of-fold probabilities: the middle of those within half a point of it."""
    grid = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * ((p >= c) & (y == 1)).sum() / max((p >= c).sum() + (y == 1).sum(), 1) for c in grid])
    best = grid[f1 >= f1.max() - 0.005]
    return float(best[len(best) // 2])


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a probability p_ for each category (double) and toxic (boolean)."""
    added = [f"p_{c}" for c in chain.categories]
    docs = without(docs, *added, "toxic")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most most_words words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in slices(batches, text_col):
            p = np.array([chain.predict(chain.features(t)) for t in utf8(batch.column(text_col))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(p[:, k]) for k in range(len(added))), pa.array(p[:, -1] >= chain.cut)], names=[*names, *added, "toxic"])

    fields = [*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added), T.StructField("toxic", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(fields))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES), "toxic")
