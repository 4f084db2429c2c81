"""The whole pipeline against a plain Python version, and the registered queries' names."""

import random
import re
import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from probelight.llm import packing, quality_rules, simhash

from .test_text_operators import brute_best_fit, brute_components

WORD = r"[^\x20\x09-\x0D]+"
SHARED = "This shared line has more than forty characters in it."


def tables():
    rng = random.Random(4)
    vocab = ["the", "of", "and", "to", *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300))]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(20)) for k in range(3)]
    texts = [say(rng.randint(12, 300)) for _ in range(40)]
    texts += [say(30) + "\n" + SHARED + "\n" + say(30) for _ in range(6)]
    texts += [say(30) + " " + items[0][1] + " " + say(10), say(2000) + " " + items[1][1], say(400)]
    texts += [texts[-1] + " more", texts[3], None, "", "too short", "### %%% ".join(say(40).split()), "again and again " * 30, say(3000)]
    return [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)], items


def expected(docs, items):
    out = []
    for i, t, *_ in docs:
        w = re.findall(WORD, t or "")
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = {}
        for x in wins:
            count[x] = count.get(x, 0) + 1
        v = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines)}
        v["n_repeat_words"] = len({k + d for k, x in enumerate(wins) if count[x] > 1 for d in range(5)})
        v["n_stop_words + 1"] = sum(x in quality_rules.STOP_WORDS for x in w) + 1
        ok = v["n_words"] >= 10 and 100 * v["n_repeat_words"] <= 20 * v["n_words"]
        for _, a, b, lo, hi in quality_rules.THRESHOLDS:
            if v[b] and (lo is not None and v[a] / v[b] < lo or hi is not None and v[a] / v[b] > hi):
                ok = False
        if ok:
            out.append((i, t))
    holders = [i for i, t in out if SHARED in t.split("\n")]
    keep = max(holders) if len(holders) >= 5 else None
    out = [(i, "\n".join(x for x in t.split("\n") if keep is None or x != SHARED or i == keep)) for i, t in out]
    label = brute_components([simhash.fingerprint(t.encode()) for _, t in out])
    least = {}
    for c, (i, _) in zip(label, out):
        least[c] = min(i, least.get(c, i))
    out = [(i, t) for c, (i, t) in zip(label, out) if least[c] == i]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[k : k + 13]) for w in (norm(t) for _, t in items) for k in range(len(w) - 12)}
    clean = []
    for i, t in out:
        w = norm(t)
        hit = {k + d for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for d in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((i, t))
    return clean


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, items = tables()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = expected(docs, items)
    assert 30 < len(clean) < len(docs) - 8
    tok = Tokenizer.from_file(packing.default_vocabulary())
    want, lengths = [], []
    for i, t in clean:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cut(len(ids))):
            want.append((i, k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())))
            lengths.append(n)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == brute_best_fit(lengths, 1024)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, items = tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).dtypes == frame.dtypes


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_all_stages_read_texts_in_bounded_batches(spark, monkeypatch):
    """Also the last one, whose texts are read while it is called."""
    import corpus_pipeline

    seen = {}

    def stage(name):
        def run(spark, docs, sf_dir):
            seen[name] = {k: spark.conf.get(k) for k in corpus_pipeline.BATCHES}
            return docs.limit(1)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n, _ in corpus_pipeline.STAGES])
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(seen) == 5 and all(x == corpus_pipeline.BATCHES for x in seen.values())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1000"
