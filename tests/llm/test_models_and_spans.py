"""Secrets, repeated spans, archives, licences, toxicity and the pipeline against plain Python on small rows."""

import gzip
import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import pytest
from pyspark.sql import functions as F

from probelight.llm import common, licenses, linear, secrets, substring_dedup, toxicity, warc

VOCAB = [a + b for a in "the of and stone river light".split() for b in ("", "s", "X", "é", "42")]


def say(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_rows():
    k = "AKIA" + "Q1" * 10
    texts = [
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é end', "password: short", f"x{k} {k}", "API_KEY='abcDEF123456789'; secret=abc", None, "",
        "deadbeefdeadbeef0 deadbeef", 'pässwörd token:"p/a+b=c.d-e_fGhijk" Token=zzz', 'secret = "abc": "abcdefghijklmnop"', "bare 04dbebab91ab85687d33eeaaf9ac699e1188f962 abcDEF123456789x",
        "see abcDEF123456789. and auth=abcDEF123456789 v/abcDEF123456789/ abcDEF123456789", "password=token: abcdefghijklmnop", "." * 3000 + "abcdefghijklmnop", "x=p/a+b=c.d-e_fGhijk p/a+b=c.d-e_fGhijk...",
        "secret=onlyletters token=onlyletters. onlyletters", "token: abcdefghijklmnop secret=abcdefghijkl", "go abcdefghijkl, abcdefghijklmnop=abcdefghijkl",
    ]
    return [(i, t, f"src{i % 3}", None if i == 2 else "en", "clash", "clash", "clash") for i, t in enumerate(texts)] + [(None, texts[0], "s", "en", "c", "c", "c"), (0, "abcDEF123456789 and no more", "src0", "en", "c", "c", "c"), (0, texts[0], "src0", "en", "c", "c", "c")]


def brute_secrets(rows):
    """Base and reused spans of each row, by plain Python."""
    cut = lambda v: v.rstrip(".") if len(v.rstrip(".")) >= 12 else v
    base = []
    for _, t, *_ in rows:
        spans = [(m.start(), 0, m.end(), "assign", cut(m[2])) for m in ASSIGN.finditer(t or "") if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        base.append(spans + [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16])
    values, out = {s[4] for spans in base for s in spans}, []
    for (_, t, *_), spans in zip(rows, base):
        found = set()
        for pattern in ("[A-Za-z0-9+/_.=-]+", "[A-Za-z0-9+_.-]+"):
            for m in re.finditer(pattern, t or ""):
                found |= {(m.start() + k, m[0][k:].rstrip(".")) for k in (0, m[0].find("=") + 1)}
        extra = {(a, 3, a + len(v), "reuse", v) for a, v in found if len(v) >= 12 and v in values and not any(s[0] < a + len(v) and a < s[2] for s in spans)}
        out.append(sorted({*spans, *extra}))
    return out


def test_secrets_by_brute_force(spark):
    rows = secret_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_live string, spans string, row string").repartition(3)
    got = sorted((str(r.doc_id), [(x.start, x.n, x.end, x.kind) for x in r.spans]) for r in secrets.find_secrets(docs).collect())
    want = brute_secrets(rows)
    assert sum(x[3] == "reuse" for spans in want for x in spans) >= 10
    assert got == sorted((str(i), [x[:4] for x in spans]) for (i, *_), spans in zip(rows, want))


def test_secret_ownership(spark):
    key = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    jwt = "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSM"
    rows = [
        (1, key, "a", "en"), (2, key, "b", "en"), (3, "secret=qW8rT2yU5iO1pAsD", "a", "en"), (4, "see qW8rT2yU5iO1pAsD there", "a", "en"), (5, "password=changeme_changeme", "a", "en"),
        (6, f"token={jwt}", "a", "en"), (7, f"pasted {jwt} and key={jwt}", "c", "en"), (8, "secret=Zx9yW8vU7tS6", "a", "x"), (8, "Zx9yW8vU7tS6", "a", "y"), (9, "Zx9yW8vU7tS6.", "a", "z"),
    ]
    out = {}
    for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect():
        out.setdefault(r.doc_id, []).extend((x.kind, x.verdict, x.n_owners) for x in r.spans)
    assert out[1] == [("assign", "shared", 2), ("hex", "shared", 2)]
    assert out[3] == [("assign", "live", 1)] and out[4] == [("reuse", "live", 1)]
    assert out[5] == [("assign", "placeholder", 1)]
    assert out[6] == [("assign", "shared", 2)] and out[7] == [("reuse", "shared", 2)] * 2  # pasted bare by another owner
    assert sorted(out[8]) == [("assign", "shared", 1), ("reuse", "shared", 1)] and out[9] == [("reuse", "shared", 1)]  # three repositories


def test_secrets_of_a_key_dump_in_linear_time(spark):
    n = 32_000
    text = " ".join(f"secret={k:016x} q{k:015x}" for k in range(n // 2)) + " " + " ".join(f"{k:016x}" for k in range(n // 2))
    docs = spark.createDataFrame([(1, text, "s", "en"), (2, f"secret=q{7:015x}", "s", "en")], "doc_id long, text string, source string, lang string")
    start = time.time()
    r = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}[1]
    assert time.time() - start < 30  # a quadratic scan takes minutes
    assert len(r) == n // 2 * 3 + 1 and [(x.start, x.end) for x in r if x.kind == "reuse"] == [(text.index(f"q{7:015x}"), text.index(f"q{7:015x}") + 16)]


def test_secrets_leave_no_values_on_disk(spark, tmp_path, monkeypatch):
    value = "qW8rT2yU5iO1pAsD"
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, f"secret={value}", "a", "en"), (2, f"see {value}", "a", "en")], "doc_id long, text string, source string, lang string")
    assert sum(len(r.spans) for r in secrets.find_secrets(docs).collect()) == 2
    files = [f for f in tmp_path.rglob("*") if f.is_file()]
    assert files and not any(value.encode() in f.read_bytes() for f in files)


def span_rows(seed):
    rng = random.Random(seed)
    passage = [say(rng, n) for n in (60, 25, 20, 45)]
    texts = [say(rng, rng.randint(0, 80)) + " " + rng.choice(passage) + "\t" + say(rng, rng.randint(0, 30)) for _ in range(25)]
    texts += [passage[0], passage[0] + " " + passage[0], " ".join(["the"] * 50), "the of " * 30, None, "", " \n", texts[0], texts[3].replace("stone", "rock", 2), say(rng, 19), say(rng, 20)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_by_brute_force(spark, seed):
    rows = span_rows(seed)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] + [(None, rows[0][1], "x", "y")], "doc_id long, text string, n_words string, lang string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()}
    seen, want = set(), {}
    for i, t in rows:
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    w = (rows[0][1] or "").split()
    want[None] = (len(w), 0, " ".join(w))
    assert got == want


def test_substring_dedup_with_full_filters(spark):
    docs = spark.createDataFrame(span_rows(3), "doc_id long, text string")
    a, b = (sorted((r.doc_id, r.text) for r in substring_dedup.remove_repeats(docs, most_bits=m).collect()) for m in (1, 1 << 28))
    assert a == b


def page_rows():
    big = "<p>" + "é" * 600 + "</p>"
    html = ["<a>", None, "", big, big, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + "z" * 2000]
    return [(i, None if i == 1 else f"http://h/{i} é\n", h) for i, h in enumerate(html)] + [(None, "u", big), (4, "again", big)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(2)
    out = warc.archive_and_read(pages, f"file://{tmp_path}/w").collect()
    keep = {}
    for i, _, h in page_rows():
        if i is not None and len((h or "").encode()) >= 1000:
            keep[h] = max(i, keep.get(h, -1))
    want = []
    for i, _, h in page_rows():
        b = (h or "").encode()
        to = keep.get(h) if i is not None and keep.get(h) not in (None, i) else None
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to, None if to is not None else b))
    assert sorted(map(repr, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page, None if r.payload is None else bytes(r.payload)) for r in out))) == sorted(map(repr, want))
    # each member stands alone at its indexed place; the monolithic archives are one member each
    index = warc.read_index(spark, f"file://{tmp_path}/w/members/index").collect()
    for r in index:
        with open(r.path.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\nWARC-Type: " + r.type.encode())
    assert sum(r.type != "warcinfo" for r in index) == len(page_rows()) and any(r.type == "warcinfo" for r in index)
    assert not (tmp_path / "w" / "monolithic").exists()


def test_warc_streams_split_anywhere():
    raw = [warc.record(k, "u", b"a" * k, None) for k in range(40)]
    data = gzip.compress(b"".join(raw[:20])) + gzip.compress(b"".join(raw[20:]))
    chunks = [b"".join(raw)[k : k + 7] for k in range(0, sum(map(len, raw)), 7)]
    assert list(warc.split_records(iter(chunks))) == raw
    import io

    assert list(warc.split_records(warc.inflate(io.BytesIO(data)))) == raw


def foreign_archive():
    block = b"HTTP/1.1 200 OK\r\ncontent-type:text/html\r\n\r\n<p>hi</p>"
    digest = hashlib.sha1(b"<p>hi</p>").hexdigest().upper()
    one = lambda head, body: b"WARC/1.0\r\n" + head + b"\r\ncontent-length:%d" % len(body) + b"\r\n\r\n" + body + b"\r\n\r\n"
    return [
        one(b"WARC-TYPE:warcinfo\r\nwarc-record-id:<urn:uuid:0>", b"software: x\r\n"),
        one(b"warc-type: response\r\nWarc-Record-Id:<urn:uuid:1>\r\ncontent-type:application/http\r\n ; msgtype=response\r\nwarc-payload-digest:sha1:" + digest.encode(), block),
        one(b"WARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://h/", b"a\r\n\r\nb"),
        one(b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:1>\r\nContent-Type: application/http", b"HTTP/1.1 200 OK\r\n\r\n"),
    ]


def test_warc_of_others_is_normalised(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(foreign_archive())))
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string")
    got = warc.read_records(warc.read_index(spark, warc.normalise(archives, f"file://{tmp_path}/m"))).orderBy("offset").collect()
    assert [(r.record_id, r.record_type, r.url, r.payload and bytes(r.payload), r.refers_to) for r in got] == [
        ("<urn:uuid:0>", "warcinfo", None, b"software: x\r\n", None), ("<urn:uuid:1>", "response", None, b"<p>hi</p>", None),
        ("<urn:uuid:2>", "metadata", "http://h/", b"a\r\n\r\nb", None), ("<urn:uuid:3>", "revisit", None, None, "<urn:uuid:1>"),
    ]


def test_warc_archives_of_one_name_stay_apart(spark, tmp_path):
    paths = []
    for folder, n in (("a", 3), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "crawl.warc.gz").write_bytes(gzip.compress(b"".join(warc.record(k, folder, folder.encode() * (5 << 20 if k else 1), None) for k in range(n))))
        paths.append((f"file://{tmp_path}/{folder}/crawl.warc.gz",))
    archives = spark.createDataFrame([*paths, paths[0]], "path string")
    got = warc.read_records(warc.read_index(spark, warc.normalise(archives, f"file://{tmp_path}/m"))).collect()
    assert sorted((r.url, len(r.payload)) for r in got) == [("a", 1), ("a", 5 << 20), ("a", 5 << 20), ("b", 1), ("b", 5 << 20)]


def test_warc_columns_that_clash(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", "x" * 2000, "c", "c", 1), (2, "http://h/2", "x" * 2000, "c", "c", 2)], "page_id long, url string, html string, refers_to string, digest string, n long")
    got = warc.archive_and_read(pages, f"file://{tmp_path}/c").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to_page) for r in got) == [(1, "revisit", 2), (2, "response", None)]


@pytest.mark.parametrize("cut", [1, 8, 9, 200])
def test_warc_truncated_streams_are_errors(cut):
    import io

    rng = random.Random(1)
    raw = b"".join(warc.record(k, "u", rng.randbytes(50), None) for k in range(20))
    whole = gzip.compress(raw)
    assert len(list(warc.split_records(warc.inflate(io.BytesIO(whole))))) == 20
    with pytest.raises((EOFError, ValueError)):
        list(warc.split_records(warc.inflate(io.BytesIO(whole[:-cut]))))
    with pytest.raises((EOFError, ValueError)):  # cut between two records, and the second member damaged
        list(warc.split_records(warc.inflate(io.BytesIO(gzip.compress(raw) + whole[: len(whole) - cut]))))
    with pytest.raises(zlib.error):
        list(warc.split_records(warc.inflate(io.BytesIO(whole + b"trailing"))))


def test_warc_inflates_in_bounded_pieces():
    import io

    data = gzip.compress(b"\0" * (100 << 20))
    sizes = [len(x) for x in warc.inflate(io.BytesIO(data))]
    assert sum(sizes) == 100 << 20 and max(sizes) <= warc.PIECE


def test_warc_wrong_length_is_an_error():
    raw = warc.record(1, "u", b"abc", None).replace(b"Content-Length: ", b"Content-Length: 1")
    with pytest.raises(ValueError):
        list(warc.split_records(iter([raw * 3])))


def test_warc_empty(spark, tmp_path):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e").count() == 0


def test_logistic_finds_the_word():
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.random((400, 8)) < 0.3).astype(float)
    y = x[:, 2] * (rng.random(400) < 0.95)
    w, b = linear.logistic(x, y)
    assert w.argmax() == 2 and ((linear.sigmoid(x @ w + b) > 0.5) == (y > 0)).mean() > 0.9


def licence_rows():
    rng = random.Random(3)
    base = [say(rng, 30) + "\n" + say(rng, 12) for _ in range(60)]
    notes = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "Licensed under the Apache License, Version 2.0."]
    texts = [b + ("\n" + notes[k % 4] if k % 3 == 0 else "") for k, b in enumerate(base)]
    return [(k, t, "x") for k, t in enumerate([*texts, None, "", "mit", "Mit der Bahn"])], notes


def test_licences_on_held_out_documents(spark):
    rows, notes = licence_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.train(docs)).collect()}
    name = dict(zip(notes, ("MIT", "CC-BY-NC", "Proprietary", "Apache-2.0")))
    for i, t, _ in rows:
        want = [name[x] for x in (t or "").split("\n") if x in name]
        assert got[i].families == ",".join(want) and got[i].n_unknown == 0


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.createDataFrame(licence_rows()[0], "doc_id long, text string, x string"))


def seen_in_training():
    return " ".join([*licenses.OTHER, *licenses.OTHER_NAMES, *licenses.HARD, *(t for ts in licenses.TEMPLATES.values() for t in ts), *(n for ns in licenses.NAMES.values() for n in ns)])


def test_licence_of_no_known_family_is_unknown(model):
    for name, line in {
        "Orchard": "Released under the Orchard Community License, version 7.", "WTFPL": "SPDX-License-Identifier: WTFPL", "ISC": "Licensed under ISC.", "Quarry": "Licensed under the Quarry Source terms.",
        "Elastic": "Licensed under the Elastic License 2.0; you may not use this file except in compliance with the Elastic License.",
    }.items():
        assert name not in seen_in_training() and model.families(line.encode()) == [licenses.UNKNOWN], line
    assert model.families(b"The harbour was quiet and the version of the map was old.") == [] == model.families(b"mit")
    assert model.judge(b"the river and the stone")[0] == licenses.NONE


def test_licences_of_short_marks_and_long_lines(model):
    for mark, family in {"MIT License": "MIT", "Apache License": "Apache-2.0", "SPDX-License-Identifier: MIT": "MIT", "License: GPL-3.0": "GPL"}.items():
        assert model.families(mark.encode()) == [family], mark
    text = say(random.Random(4), 150)
    notices = [licenses.TEMPLATES["MPL-2.0"][0], "Released under the MIT License."]
    assert model.families(f"{text} {notices[0]} {text} {notices[1]} {text}".encode()) == ["MIT", "MPL-2.0"]
    assert model.families(text.encode()) == []


def test_licences_wrapped_over_lines(model):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    for width in (30, 45, 60, 76):
        wrapped = textwrap.fill(mit, width)
        n, got = model.document(f"some prose here\n\n{wrapped}\n\n{say(random.Random(2), 40)}".encode())
        assert n == wrapped.count("\n") + 5 and {f for _, fs in got for f in fs} == {"MIT"} and all(2 <= k <= n - 3 for k, _ in got), width
    assert model.document(say(random.Random(2), 40).encode() + b"\n" + say(random.Random(3), 40).encode())[1] == []


def test_licence_scores_by_brute_force(model):
    """The probability of a line, by plain sums over the n-grams that the vocabulary has."""
    for line in ("Licensed under the MIT License", "He lost the license in May", "Redistributions of source code must retain the above copyright notice", "River and stone"):
        ws = re.findall("[a-z0-9]+", line.lower())
        grams = {" ".join(ws[k : k + n]) for n in (1, 2, 3) for k in range(len(ws) - n + 1)}
        z = [float(b) + sum(float(model.w[model.vocab[g.encode()], c]) for g in grams if g.encode() in model.vocab) / math.sqrt(len(grams) + licenses.DAMP) for c, b in enumerate(model.b)]
        e = [math.exp(x / model.heat - max(z) / model.heat) for x in z]
        family, p = model.judge(line.encode())
        best = max(range(len(z)), key=z.__getitem__)
        assert p == pytest.approx(e[best] / sum(e), abs=1e-5)
        assert family == licenses.CLASSES[best] or family in (licenses.UNKNOWN, licenses.NONE) and (p < model.least or best > 1)


def test_windows_skip_nothing_that_would_be_found(model, monkeypatch):
    """The bound that spares most windows gives the same families as judging every window."""
    rng = random.Random(6)
    marks = ["Released under the MIT License.", "license", "permission is", "Apache", "public domain", "version 2", *(t for ts in licenses.TEMPLATES.values() for t in ts)]
    texts = [f"{say(rng, rng.randint(0, 40))} {rng.choice(marks)} {say(rng, rng.randint(0, 40))}" for _ in range(60)]
    fast = [model.families(t.encode()) for t in texts]
    monkeypatch.setattr(model, "floor", 0.0)
    assert [model.families(t.encode()) for t in texts] == fast


BAD, POOR = ("grumph", "snarl", "blech"), ("zzlow", "zzmeh")


def toxic_rows(seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        poor = rng.random() < 0.4
        bad = rng.random() < (0.5 if poor else 0.1)
        ws = say(rng, rng.randint(5, 200)).split()
        for words, some in ((BAD, bad), (POOR, poor)):
            for _ in range(rng.randint(1, 5) if some else 0):
                ws.insert(rng.randrange(len(ws)), rng.choice(words))
        rows.append((i, " ".join(ws), "x", "y", "z"))
        if i < 400:
            labels.append((i, int(bad) if rng.random() > 0.03 else 1, int(not poor)))
    rows += [(600, None, "x", "y", "z"), (601, "", "x", "y", "z"), (None, "grumph snarl", "x", "y", "z"), (602, "the of stone " * 100_000 + "grumph snarl blech " * 2000, "x", "y", "z")]
    return rows, [*labels, (None, 1, 0), (5, None, 1), (6, 0, None)]


TOXIC_DOCS, TOXIC_LABELS = "id long, text string, toxic string, p_toxic string, _id string", "id long, toxic int, quality int"


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, TOXIC_DOCS)
    chain = toxicity.fit(docs, spark.createDataFrame(labels, TOXIC_LABELS), id_col="id")
    got = {r.id: r for r in toxicity.score(docs, chain).collect()}
    truth = {i: any(w in t for w in BAD) for i, t, *_ in rows[:600]}
    good = {i: not any(w in t for w in POOR) for i, t, *_ in rows[:600]}
    assert sum(got[i].toxic == truth[i] for i in range(400, 600)) >= 196
    assert sum((got[i].p_quality > 0.5) == good[i] for i in range(400, 600)) >= 190
    assert not got[600].toxic and not got[601].toxic and got[None].toxic and got[602].toxic
    assert chain.models[1][0].size == len(chain.words) + 1 and chain.models[1][0][-1] != 0  # the first category feeds the second


def test_toxicity_scores_by_brute_force(spark):
    rows, labels = toxic_rows(3)
    docs = spark.createDataFrame(rows, TOXIC_DOCS).repartition(3)
    chain = toxicity.fit(docs, spark.createDataFrame(labels, TOXIC_LABELS), id_col="id")
    got = {r.id: r for r in toxicity.score(docs, chain).collect()}
    for i, t, *_ in rows:
        words = re.findall("[a-z0-9]+|[^\x00-\x7f]+", (t or "").lower()) if (t or "").isascii() else re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
        count = {}
        for w in words:
            for x in (w, *(["^" + w[:6]] if len(w.encode()) > 6 else [])):
                count[x] = count.get(x, 0) + 1
        before = []
        for weights, bias in chain.models:
            z = bias + sum(float(weights[k]) * math.log(1 + count[w.decode()]) for w, k in chain.words.items() if w.decode() in count)
            z += sum(p * float(v) for p, v in zip(before, weights[len(chain.words) :]))
            before.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        assert got[i].p_quality == pytest.approx(before[0], abs=1e-9) and got[i].p_toxic == pytest.approx(before[1], abs=1e-9)
        assert got[i].toxic == (before[1] >= chain.cut)


def test_toxicity_words_of_a_fold_are_chosen_outside_it(spark):
    rng = random.Random(4)
    rows = [(i, [i % 2, int(f == 1 and i % 3 == 0)], f, list({rng.choice("abcdefgh") for _ in range(4)} | ({"leak"} if f == 1 and i % 3 == 0 else set()) | ({"odd"} if i % 2 else set()))) for i in range(200) for f in [i % 5]]
    frame = spark.createDataFrame(rows, "id long, y array<int>, fold int, words array<string>").withColumn("counts", F.array_repeat(F.lit(1), F.size("words")))
    counts = toxicity.word_counts(frame, 2)
    totals = {f: [sum(r[2] == f for r in rows), *(sum(r[1][c] for r in rows if r[2] == f) for c in range(2))] for f in range(5)}
    for held in (0, 1, None):
        for c in range(2):
            inside = [r for r in rows if r[2] != held]
            pos, score_of = max(sum(r[1][c] for r in inside), 1), {}
            neg = max(len(inside) - pos, 1)
            for w in {x for r in inside for x in r[3]}:
                cell = lambda f, y: sum(w in r[3] and r[1][c] == y for r in inside if r[2] == f)  # noqa: E731, B023
                fs = [f for f in range(5) if f != held]
                p, q = [cell(f, 1) for f in fs], [cell(f, 0) for f in fs]
                up, down = sum(a * neg > 2 * b * pos for a, b in zip(p, q)), sum(2 * a * neg < b * pos for a, b in zip(p, q))
                if sum(p) + sum(q) >= 5 and max(up, down) >= len(fs) - 1:
                    odds = math.log((sum(p) + 0.5) / (pos + 1)) - math.log((sum(q) + 0.5) / (neg + 1))
                    score_of[w] = abs(odds / math.sqrt(1 / (sum(p) + 0.5) + 1 / (sum(q) + 0.5)))
            want = sorted(score_of, key=lambda w: (-round(score_of[w], 9), w))[:3]
            assert toxicity.choose_words(counts, totals, [(c, held)], 3) == [want]
    leak, odd = toxicity.choose_words(counts, totals, [(1, 1), (0, 1)], 9)
    assert "leak" not in leak and "odd" in odd


def test_stems_are_whole_characters():
    assert toxicity.stem("ééééééé".encode()) == b"^" + "éééééé".encode() and toxicity.stem(b"abcdefgh") == b"^abcdef"


def test_models_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [r.toxic for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [False]
    empty = docs.limit(0)
    assert licenses.scan(empty, licenses.train(empty)).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert secrets.find_secrets(empty.withColumns({"source": F.lit("s"), "lang": F.lit("l")})).count() == 0
