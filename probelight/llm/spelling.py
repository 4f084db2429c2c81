"""Spelling variants: words one edit apart, found by pivotal bigrams, and the frequent form of each.

1. Bigrams have one order, the rarest (in most few words) first, then by their letters.  A word's prefix is its three
   first bigrams in that order (with up to five places of the last one, as an edit in a run of equal letters can shift
   which places come first).  Two of the three that share no letter, of the least total frequency, are its pivots; a
   dynamic programme over places picks them.
2. One edit destroys at most one of two disjoint bigrams.  So of two near words the one whose prefix ends first has a
   pivot that stands in the other's prefix, its place shifted by the difference of lengths at most.
3. Bigrams alone are weak keys (check_s: 718 million pairs for 367,521 words).  A surviving pivot has the edit on one
   side: the other side, pivot included, is equal, and of the edited side its first or its second half is.  The join key
   is a hash of the pivot with the equal side and half, and the length of the pivot's word (22 million pairs).
4. Pairs with one key are verified by their distance and made distinct.

Null texts have no words; a null id is written as the empty string before the colon; repeated rows count again; very long
runs have at most seven prefix places.  Empty tables give no rows.  Only the two named columns are read, so others may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table

LEAST, TYPO = 7, 31
RUN = "[a-z\\u00C0-\\u00FF]{%d,}" % LEAST
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of a prefix's last bigram that count as prefix.
TIES = 5


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least seven letters that occur at least twice, one letter of every 31st run left out."""
    low = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % TYPO == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


def gram_counts(vocabulary: DataFrame) -> dict[str, int]:
    """How many words have each bigram, by place: at most the square of the 90 letters, whatever the corpus."""
    grams = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("g"))
    return {r.g: r.n for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()}


def prefix(word: str, rank: dict[str, int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """(the three first bigrams as (rank, place), all prefix places, the last one's rank)."""
    every = sorted([(rank[word[i : i + 2]], i) for i in range(len(word) - 1)])
    first, last = every[:3], every[2][0]
    ties = [i for r, i in every[: 2 + TIES] if r == last][:TIES]
    return first, [i for r, i in first if r < last] + ties, last


def pivots(first: list[tuple[int, int]], weight: list[int]) -> tuple[int, int]:
    """Places of two disjoint bigrams of least total weight: best[k] is the best one that ends before the k-th place."""
    best, found = None, None
    waiting = sorted((i, weight[r]) for r, i in first)
    done = 0
    for i, w in waiting:
        while done < len(waiting) and waiting[done][0] + 2 <= i:  # may stand left of i
            c = (waiting[done][1], waiting[done][0])
            best = c if best is None else min(best, c)
            done += 1
        if best is not None and (found is None or best[0] + w < found[0]):
            found = (best[0] + w, best[1], i)
    return found[1], found[2]


def pivot_keys(word: str, i: int) -> Iterator[str]:
    """What partners have in common with ``word`` if its bigram at ``i`` survives the edit."""
    n = len(word)
    h = (n - i - 2) // 2
    yield f"a{n}:{word[: n - h]}"  # the edit is in the last h letters
    yield f"b{n}:{word[: i + 2]}:{word[n - h :]}"  # between the bigram and them
    h = i // 2
    yield f"c{n}:{word[:h]}:{word[i:]}"  # between the first h letters and the bigram
    yield f"d{n}:{word[h:]}"  # in the first h letters


def partner_keys(word: str, i: int) -> Iterator[str]:
    """The same from the partner's view, its bigram at ``i``, for pivots' words a letter shorter, as long, and longer."""
    n = len(word)
    for more in (-1, 0, 1):
        m = n + more  # length of the pivot's word
        if m >= i + 2:  # an edit to the right: the pivot is at i
            h = (m - i - 2) // 2
            if m - h <= n:
                yield f"a{m}:{word[: m - h]}"
            if n - h >= i + 2:
                yield f"b{m}:{word[: i + 2]}:{word[n - h :]}"
        j = i + more  # an edit to the left: the pivot is at j
        if j >= 0:
            h = j // 2
            if h <= i:
                yield f"c{m}:{word[:h]}:{word[i:]}"
            if h - more >= 0:
                yield f"d{m}:{word[h - more :]}"


def _keys(vocabulary: DataFrame, shared, pivot: bool) -> DataFrame:
    """(word, n, last, key) of every word's pivots, or of its prefix bigrams as partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weight = shared.value
        for batch in batches:
            flat, size, lasts = [], [], []
            for w in batch.column("word").to_pylist():
                first, places, last = prefix(w, rank)
                if pivot:
                    keys = {k for i in pivots(first, weight) for k in pivot_keys(w, i)}
                else:
                    keys = {k for i in places for k in partner_keys(w, i)}
                flat += map(xxhash.xxh3_64_intdigest, keys)
                size.append(len(keys))
                lasts.append(last)
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.array(flat, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(lasts, pa.int32()), keys], names=["word", "n", "last", "keys"])

    found = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, last int, keys array<long>")
    return found.select("word", "n", "last", F.explode("keys").alias("key"))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): the distinct pairs of words one edit apart, a < b, with their counts."""
    counts = gram_counts(vocabulary)
    order = sorted(counts, key=lambda g: (counts[g], g))
    shared = vocabulary.sparkSession.sparkContext.broadcast(({g: k for k, g in enumerate(order)}, [counts[g] for g in order]))
    s, r = _keys(vocabulary, shared, True).alias("s"), _keys(vocabulary, shared, False).alias("r")
    ok = (F.col("s.key") == F.col("r.key")) & (F.col("s.last") <= F.col("r.last")) & (F.levenshtein("s.word", "r.word", 1) == 1)
    low = F.col("s.word") < F.col("r.word")
    side = lambda x, y, c: F.when(low, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    found = s.join(r, ok).select(side("s", "r", "word").alias("a"), side("s", "r", "n").alias("n_a"), side("r", "s", "word").alias("b"), side("r", "s", "n").alias("n_b"))
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms are followed to the last, twice as far with each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = materialize(now.join(nxt, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        discard(now)
        moved = out.filter("_moved").limit(1).count()
        now = out.drop("_moved")
        now._written_at = out._written_at
        if not moved:
            return now


def variants(docs: DataFrame, factor: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): see the contract of ``op13_spelling``; ``factor`` is that of its counts."""
    vocabulary = materialize(words(docs, id_col, text_col), "spelling-words")
    pairs = materialize(near_pairs(vocabulary), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("_best"))
    big = -F.col("_best.m") >= F.col("n") * factor
    found = vocabulary.join(best, "word", "left").select("word", F.when(big, F.col("_best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, -F.col("_best.m")).alias("form_n"))
    found = materialize(found, "spelling-forms")
    discard(pairs)
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))


#: CRC-32 by bytes: a table of 256 values from the polynomial, then one step for each byte.
_TABLE = "list_transform(range(0, 256), lambda b: list_reduce(list_concat([b::UBIGINT], list_transform(range(0, 8), lambda i: 0::UBIGINT)), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"
SQL = f"""
WITH r AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL),
t AS (SELECT {_TABLE} AS t),
c AS (SELECT w, n, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i::INT + 1, 2))::UBIGINT)),
    lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) AS h FROM r, t),
v AS (SELECT w AS word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN w[1:(h % length(w))::INT] || w[(h % length(w))::INT + 2:] ELSE w END AS w FROM c)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
d AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM v),
e AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE word[1:i - 1] || word[i + 1:] END AS x FROM d),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM e a JOIN e b ON a.x = b.x AND a.word <> b.word AND (a.i = 0 OR b.i = 0 OR a.i = b.i)),
f AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
g AS (SELECT v.word, CASE WHEN f.m >= 10 * v.n THEN f.other END AS form, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN f.m >= 10 * v.n THEN f.m END AS form_n FROM v LEFT JOIN f ON v.word = f.word),
l AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT word, word AS root, form AS nxt FROM g UNION ALL SELECT w.word, g.word, g.form FROM w JOIN g ON w.nxt = g.word) SELECT word, root FROM w WHERE nxt IS NULL))
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN l ON g.word = l.word"""
