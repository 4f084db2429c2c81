"""BPE, prefix tries and spelling variants against plain Python and the tokenizers library on small rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from probelight.llm import bpe, packing, prefix_trie, spelling


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Bpe(vocabulary())


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


ODD = [None, "", " ", "\n\n", "a  b\n\n c ", "x" + " " * 300 + "b", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't 'Tis we'LL", "\x1c\x1f\x85 ᠎　x", "é 中文字 😀👍🏽 ﷽", "\U00010400\U0001d7d8", "͸ Ᲊ ꟝"]


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(3)
    alphabet = [*"aaabcdefgh   \n\n\t.,'sdtl0123éß中 😀", "don't", "<|endoftext|>", "  ", " the", "\r\n", "́"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [texts[20], texts[20], "word " * 20_000, "ab" * 30_000]
    rows = [(None if n == 5 else n % 300, t, "clash", b"clash") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary").repartition(3)
    want = []
    for i, t, *_ in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), e, library.decode(e, skip_special_tokens=False)))
    got = [(str(r.doc_id), ids_of(r.ids), r.text) for r in bpe.round_trip(docs, vocabulary()).collect()]
    assert sorted(got) == sorted(want)
    apart = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).collect()
    assert sorted((str(r.doc_id), ids_of(r.ids), r.text) for r in apart) == sorted(want)
    assert bpe.round_trip(docs.limit(0), vocabulary()).count() == 0


def test_every_token_is_its_own_encoding(encoder):
    by_id = {i: t for t, i in bpe.Vocabulary(vocabulary()).ids.items()}
    assert all(encoder.merge(t) == [i] for i, t in by_id.items())


def test_pairs_by_merging(encoder, library):
    """The table's answer for two tokens is whether the library keeps them apart."""
    rng = random.Random(4)
    byte = bpe.byte_letters()
    words = [i for t, i in bpe.Vocabulary(vocabulary()).ids.items() if t.isascii() and t.isalpha()]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        text = "".join(t for i in (a, b) for t in [bytes(byte[c] for c in library.id_to_token(i)).decode()])
        assert encoder.compatible(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


def test_bpe_is_linear_and_decodes_in_slices(encoder, library, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    decoder = bpe.Decoder(vocabulary())
    for text in ("a" * 200_000, "".join(rng.choice("abcdeé") for _ in range(100_000)), " " * 100_000 + "x"):
        raw = encoder.encode(text)
        assert ids_of(raw) == library.encode(text, add_special_tokens=False).ids
    some = "é中😀 text" * 50
    assert decoder.decode(encoder.encode(some)) == some
    broken = np.array([bpe.Vocabulary(vocabulary()).ids["Ã"], 220], "<u4").tobytes()  # half of a letter
    assert decoder.decode(broken) == "� " == library.decode(ids_of(broken), skip_special_tokens=False)
    with pytest.raises(IndexError):
        decoder.decode(np.array([60_000], "<u4").tobytes())


def test_latin_pattern_is_the_library_split(encoder):
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f" {c} {c}{c}9", f"'{c}s {c}"):
            assert encoder._split(text) == [t for t, _ in encoder.library_split(text)]


# --- prefix trie --------------------------------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, key string, depth long, path string"


def plain_trie(rows):
    """The contract's nodes from dictionaries of prefixes."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    convs = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    members, ends = {}, {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        words = len([w for w in __import__("re").split("[ \t-\r]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize(("seed", "block"), [(1, 200_000), (2, 5), (3, 1)])
def test_trie_by_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "bot", None, ""]), rng.choice(["hi", "hello there", "a  b\n c", None, "", " ", "é 中"]))
    rows = []
    for c in [*range(90), *range(300, 340), 1000]:
        hot = c % 3 == 0  # a third of the conversations are alike
        for k in range(5 if hot else rng.randint(1, 6)):
            rows.append((c, None if rng.random() < 0.1 else k, *(("user", f"t{k}") if hot else say()), "clash", 7, "clash"))
    rows += [(40, 0, "user", "twice", "c", 1, "c"), (40, 0, "user", "twice", "c", 1, "c"), (None, 1, "user", "nobody's", None, None, None), (2000, k := 0, "user", "w " * 5000, "c", 1, "c"), (-5, 3, None, None, "c", 1, "c")]
    rows += [(501, k, "user", f"{k}", "c", 1, "c") for k in range(40)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert of(prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.conversations(df)))) == plain_trie(rows)


def test_empty_trie_and_turnless_conversations(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.conversations(df))).count() == 0
    rows = [(c, 0, "user", "x", "c", 1, "c") for c in range(21, 40)]  # their common source isn't there
    got = of(prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.conversations(spark.createDataFrame(rows, TURNS)))))
    assert got == plain_trie(rows) and got[0][1] == 0 and len(got) == 2


def test_double_array_packs_and_walks():
    rng = random.Random(6)
    seqs = sorted({tuple(rng.randint(1, 30) for _ in range(rng.randint(0, 6))) for _ in range(800)})
    codes, sizes = np.array([c for s in seqs for c in s]), np.array([len(s) for s in seqs])
    trie = prefix_trie.DoubleArray(codes, np.cumsum(sizes) - sizes, sizes)
    at = {(): 0}
    for s in seqs:
        for d in range(len(s)):
            at[s[: d + 1]] = int(trie.walk(np.array([at[s[:d]]]), np.array([s[d]]))[0])
    assert len(set(at.values())) == len(at) and min(at.values()) == 0  # a slot of its own for each prefix
    assert (trie.check[: trie.end] >= 0).sum() == len(at)
    for p, node in list(at.items())[:200]:
        for c in range(1, 31):
            assert (int(trie.walk(np.array([node]), np.array([c]))[0]) >= 0) == (p + (c,) in at)


# --- spelling -----------------------------------------------------------------------------------------------------
def plain_words(rows):
    import re

    count = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 7
    return {w: n for w, n in count.items() if n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(count):
    links = {w: [v for v in count if near(w, v)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(links[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 10 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(links[w]), count[form[w]] if form[w] else -1))
    return sorted(out)


def spelled(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def edited(rng, w):
    k, c = rng.randrange(len(w) + 1), rng.choice("abné")
    return rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])


@pytest.mark.parametrize("seed", range(3))
def test_variants_by_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abn" if k % 2 else "abcdeéèßn") for _ in range(rng.randint(6, 11))) for k in range(40)] + ["banananana", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab"]
    said = []
    for w in base:
        said += [w] * rng.choice([1, 2, 300, 30])
        for _ in range(8):
            v = edited(rng, w)
            said += [v] * rng.choice([2, 3, 25]) + [edited(rng, v)] * 2
    rng.shuffle(said)
    said = [w.upper() if rng.random() < 0.1 else w for w in said]
    rows = [(None if k == 3 else k, " ".join(said[a : a + 50]), "clash", "clash") for k, a in enumerate(range(0, len(said), 50))]
    rows += [rows[1], (None, None, None, None), (9, "", "", ""), (10, "a" * 5000 + " " + "a" * 5000 + "7" + "a" * 4999 + "x" + "a" * 4999, "c", "c"), (10, "a" * 4999, "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, run string").repartition(3)
    want = plain_variants(plain_words(rows))
    assert any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want)
    assert spelled(spelling.variants(df)) == want
    assert spelling.variants(df.limit(0)).count() == 0


def test_pivots_reach_every_near_pair():
    """The keys of pivots and partners meet for all near pairs of random words over few letters, also without Spark."""
    rng = random.Random(8)
    pool = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(150)}
    pool |= {v for w in list(pool) for v in [edited(rng, w)] if len(v) >= 7}
    grams = Counter(w[i : i + 2] for w in pool for i in range(len(w) - 1))
    order = sorted(grams, key=lambda g: (grams[g], g))
    rank, weight = {g: k for k, g in enumerate(order)}, [grams[g] for g in order]
    pivot, partner, last = {}, {}, {}
    for w in pool:
        first, places, last[w] = spelling.prefix(w, rank)
        two = spelling.pivots(first, weight)
        assert two[1] - two[0] >= 2 and len(places) <= 2 + spelling.TIES
        assert weight[rank[w[two[0] : two[0] + 2]]] + weight[rank[w[two[1] : two[1] + 2]]] == min(weight[a[0]] + weight[b[0]] for a in first for b in first if b[1] - a[1] >= 2)
        pivot[w] = {k for i in two for k in spelling.pivot_keys(w, i)}
        partner[w] = {k for i in places for k in spelling.partner_keys(w, i)}
    found = 0
    for a in pool:
        for b in pool:
            if near(a, b) and last[a] <= last[b]:
                found += 1
                assert pivot[a] & partner[b], (a, b)
    assert found > 100


def test_words_of_letters_are_one_pre_token():
    """Pieces of letters skip the split; ids are the library's, and a piece's pairs come from the table."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    enc, library = bpe.Bpe(path), Tokenizer.from_file(path)
    split = []
    enc._split = lambda text, f=enc._split: split.append(text) or f(text)
    texts = ["word", "Plain words of letters only", "zqxjkvwyzqxjkv xqzzqx" * 3, "it's don't s t re", "größer als x", "a" * 3000, " lead", "tail ", "a  b", "x1 y2"]
    for t in texts:
        assert enc.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert "word" not in split and " words" not in split and " y2" in split
