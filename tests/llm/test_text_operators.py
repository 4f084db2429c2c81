"""Rules, lines, contamination, fingerprints and packing against plain Python on small rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from probelight.llm import components, decontaminate, line_dedup, packing, quality_rules, simhash

DOCS = "doc_id long, text string, lang string, n_lines string, fp string, _key string, _line_id string, _drop string, _spans string, _span_id string"
LINE = "A line of more than forty characters, as it happens to be."


def corpus():
    rng = random.Random(7)
    vocab = [a + b for a in "the of and stone river light".split() for b in ("", "s", "X", "é", "42")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [say(rng.randint(1, 60)) + "\n" + say(5) for _ in range(40)]
    texts += [f"{say(12)}\n  {LINE.upper() if k % 2 else LINE}\t\n{say(3)}" for k in range(7)]
    long = say(400)
    near = [long, long + " more", long.replace("stone", "rock", 1), long.upper()]
    texts += [*near, None, "", "   \n\t ", "x", "one two three", "a  b\n\n c ", f"{say(3000)}", " lead", "trail ", "<|endoftext|> it's 'quoted'  twice"]
    texts += [texts[0], texts[0]]
    return [(i, t, None if i % 3 else "en", *["clash"] * 7) for i, t in enumerate(texts)] + [(None, f"{LINE}\nnull id", *[None] * 8), (3, texts[3], "en", *["c"] * 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def test_line_dedup_by_brute_force(spark, docs):
    rows = corpus()
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    ids = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                ids.setdefault(key(x), set()).add(i)
    drop = {k: max(v) for k, v in ids.items() if len(v) >= 5}
    assert drop
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in drop or drop[key(x)] == i]
        want.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got) == sorted(want)


def test_line_dedup_with_a_full_filter_is_still_exact(spark, docs):
    a = line_dedup.dedup_lines(docs, most_bits=1).select("doc_id", "text").collect()
    assert sorted(map(repr, a)) == sorted(map(repr, line_dedup.dedup_lines(docs).select("doc_id", "text").collect()))


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in corpus():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        times = Counter(wins)
        rep = {k + d for k, x in enumerate(wins) if times[x] > 1 for d in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_repeat_words == len(rep) and r.n_stop_words == sum(x in quality_rules.STOP_WORDS for x in w)
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))


def test_quality_stop_words_by_share_at_every_length(spark):
    rng = random.Random(2)
    plain = lambda n: " ".join(f"{rng.randrange(10**6)}x" for _ in range(n))
    texts = [plain(12), plain(49), plain(51), plain(48) + " the of and", plain(60_000), " ".join(plain(30) + " the" for _ in range(2000))]
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[k].kept for k in range(6)] == [True, True, False, True, False, True]
    assert out[5].n_stop_words == 2000 and out[4].failed_rules == "stop_words"


def test_decontaminate_by_brute_force(spark, docs, monkeypatch):
    rows = corpus()
    items = [(1, rows[5][1]), (2, "Stone river"), (3, None), (4, rows[60][1] if rows[60][1] else "x"), (None, "lights"), (2, "stone river"), (5, "!!"), (6, " ".join(rows[50][1].split()[100:130]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = []
    for i, t in items:
        w = norm(t)
        wins += [(i, w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1) if w]
    clash = docs.withColumns({c: F.lit("clash") for c in ("_found", "_starts", "_ends", "_items", "starts", "items", "block")})
    for most, piece in ((1_000_000, 4096), (20, 16)):  # one block, many blocks of cut items
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        got = {}
        found = decontaminate.find_spans(clash, bench, block_words=most, blocks_a_scan=3)
        assert found.columns[: len(clash.columns) - 2] == [c for c in clash.columns if c not in ("starts", "items")]
        for r in decontaminate.flag(found).collect():
            got[(r.doc_id, r.text)] = (r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated)
        for i, t, *_ in rows:
            w, hit, who = norm(t), set(), set()
            for item, x in wins:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit.update(range(k, k + len(x)))
                        who |= {str(item)} if item is not None else set()
            assert got[(i, t)] == (len(w), len(hit), len(who), tuple(sorted(who)), bool(hit) and 20 * len(hit) >= len(w))


def test_full_blocks_stay_small():
    """Eight blocks of the largest size, loaded together, under 250 MB of a worker."""
    import subprocess
    import sys

    code = """
import pickle, random, sys
from probelight.llm import decontaminate as d
rng = random.Random(1)
words = [b"w%d" % k for k in range(40000)]
items = [(str(k), [rng.choice(words) for _ in range(50)], False) for k in range(d.BLOCK_WORDS // 50)]
raw = pickle.dumps(d.Automaton(items), protocol=5)
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
del items, words
before = rss()
kept = [pickle.loads(raw) for _ in range(d.BLOCKS_A_SCAN)]
print(len(raw) >> 20, rss() - before, sum(len(a.length) for a in kept))
"""
    root = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True).stdout.split()
    print("MB pickled a block, MB of eight loaded:", out[:2])
    assert int(out[0]) < 40 and int(out[1]) < 250


def test_decontaminate_removes_spans_beyond_the_limits(spark):
    item = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    rest = [f"w{k}" for k in range(400)]
    long = " ".join(rest)
    rows = [
        (1, " ".join(rest[:300]) + " ... ZERO, " + " ".join(item[1:]) + "! " + " ".join(rest[300:])),  # 15 of 415 words: stays
        (2, "intro " + " ".join(item) + " (" + " ".join(item[:13]) + ") end"),  # over a twentieth: both go
        (3, long + " ü" + "; ".join([*item, *item[:13]]) + " tail " + long),  # 28 words in a row: over 20
        (4, None), (5, ""), (6, " ".join(item)), (7, long * 50),
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item + item[:13]))], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.remove_spans(decontaminate.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), bench)).collect()}
    text = dict(rows)
    assert (out[1].text, out[1].n_cut) == (text[1], 0)
    assert (out[2].text, out[2].n_cut) == ("intro ) end", 28)  # one span, the bracket inside it
    first, last = text[3].index("ü") + 1 + len("zero; "), text[3].index(" tail")
    assert out[3].n_cut == 28 - 1 and out[3].text == text[3][:first] + text[3][last:]  # "üzero" is another word
    assert (out[4].text, out[4].n_cut, out[5].text) == (None, 0, "") and (out[6].text, out[6].n_cut) == ("", 15) and out[7].text == text[7]


def test_automaton_is_packed():
    import pickle

    rng = random.Random(5)
    words = [f"w{rng.randrange(20_000)}".encode() for _ in range(100_000)]
    auto = decontaminate.Automaton([("i", words[k : k + 4000], False) for k in range(0, len(words), 4000)])
    assert len(pickle.dumps(auto)) < 40_000_000
    spans, items = auto.find([b"x", *words[8100:8113], b"x", *words[50:62]])
    assert spans == [(1, 14)] and items == {"i"}


def test_decontaminate_empty_benchmark(spark, docs):
    out = decontaminate.flag(decontaminate.find_spans(docs, spark.createDataFrame([], "item_id long, text string")))
    assert out.filter("n_hit > 0 OR contaminated").count() == 0


def brute_components(fps: list[int]) -> list[int]:
    """The least index of each one's class."""
    f = np.array(fps, dtype=np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprint():
    t = "The quick brown FOX jumps over it"
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(4)]
    assert simhash.fingerprint(t.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest("a b", 42)


def test_spark_and_library_hash_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] & 0xFFFFFFFFFFFFFFFF == xxhash.xxh64_intdigest("a b é", 42)


def test_near_duplicates_of_documents(spark, docs):
    rows = corpus()
    fps = [simhash.fingerprint((t or "").encode()) for _, t, *_ in rows]
    ids = [10**9 if r[0] is None else r[0] for r in rows]
    label = brute_components(fps)
    least = {}
    for c, i in zip(label, ids):
        least[c] = min(i, least.get(c, i))
    want = sorted((i, f, least[c]) for i, f, c in zip(ids, fps, label))
    got = sorted((10**9 if r.doc_id is None else r.doc_id, r.fp & 0xFFFFFFFFFFFFFFFF, 10**9 if r.component_id is None else r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize("chunk", [2048, 8, 3])
def test_links_of_clustered_fingerprints(spark, chunk):
    rng = random.Random(chunk)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centres for _ in range(40)}
    fps |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    label = brute_components(fps)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    comp = {r.node & 0xFFFFFFFFFFFFFFFF: r.component for r in components.connected_components(simhash.links(frame, chunk=chunk)).collect()}
    mine = [comp.get(f, f - (1 << 64) if f >> 63 else f) for f in fps]
    assert len(set(zip(label, mine))) == len(set(label)) == len(set(mine))


def test_more_fingerprints_get_wider_blocks(spark):
    assert [len(simhash.blocks_for(n)) for n in (0, 1 << 20, 1 << 26, 1 << 40)] == [6, 6, 7, 8]
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps = list({*fps, *(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for f in fps for _ in range(4))})
    label = brute_components(fps)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for n in (1 << 26, 1 << 40):
        comp = {r.node: r.component for r in components.connected_components(simhash.links(frame, blocks=simhash.blocks_for(n))).collect()}
        mine = [comp.get(simhash._signed(f), simhash._signed(f)) for f in fps]
        assert len(set(zip(label, mine))) == len(set(label)) == len(set(mine))


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    rows = corpus()
    got = packing.pack(docs, packing.default_vocabulary()).collect()
    by = {}
    for r in got:
        by.setdefault(-1 if r.doc_id is None else r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    want = {}
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [(0, min(first, len(ids)))] + [(a, 1024) for a in range(first, len(ids), 1024)]
        want.setdefault(-1 if i is None else i, []).extend((k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())) for k, (a, n) in enumerate(cuts))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024


def brute_best_fit(lengths: list[int], size: int) -> int:
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(size - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_supersteps_are_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = sorted(packing.supersteps(counts, 30))
    seen, used = {}, {}
    for k, (n, lo, first, off) in enumerate(plan):
        hi = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == n else counts[n]
        for r in range(lo, hi):
            seen[n] = seen.get(n, 0) + 1
            used.setdefault(first + r - lo, []).append((off, n))
    assert seen == counts
    for s in used.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 30
    assert len(used) == brute_best_fit(lengths, 30)


@pytest.mark.parametrize("f", [
    lambda d, s: line_dedup.dedup_lines(d), lambda d, s: quality_rules.judge(d), lambda d, s: simhash.near_duplicates(d),
    lambda d, s: decontaminate.find_spans(d, s.createDataFrame([(1, "a b")], "item_id long, text string")),
    lambda d, s: packing.pack(d, packing.default_vocabulary()),
])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], DOCS), spark).count() == 0


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000 + "b", "a b" + "\n" * 2_000_000 + "c d"])
def test_ids_of_a_long_white_space_run(text):
    enc = packing.Encoder(packing.default_vocabulary())
    assert enc.encode(text) == np.array(enc.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_hashes_seen_again_are_all_given_however_full_the_filter_is():
    h = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    row = lambda x: pa.RecordBatch.from_pydict({"part": pa.array([0]), "one": pa.array([x.tobytes()], pa.binary()), "more": pa.array([b""], pa.binary())})
    out = line_dedup._fold(512, True)(iter([row(h[k : k + 1]) for _ in range(2) for k in range(h.size)]))
    assert set(h.tolist()) <= {x & (1 << 64) - 1 for b in out for x in b.column("h").to_pylist()}


def test_line_dedup_sends_small_batches_and_only_documents_that_lose_lines(spark, monkeypatch):
    line, seen = "a line of more than forty characters, in all of them", []
    docs = spark.createDataFrame([*((k, f"{line}\n{k}\n") for k in range(6)), (6, "\n\n é"), (7, None), (None, line), (8, "")], "doc_id long, text string")
    digests = line_dedup.line_digests
    monkeypatch.setattr(line_dedup, "line_digests", lambda *a: (seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), digests(*a))[1])
    out = line_dedup.dedup_lines(docs)
    assert seen == ["1000"] and out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got == {**{k: (f"{k}\n", 3, 1) for k in range(5)}, 5: (f"{line}\n5\n", 3, 0), 6: ("\n\n é", 3, 0), 7: ("", 1, 0), None: (line, 1, 0), 8: ("", 1, 0)}
