"""Byte-level BPE without a merge loop: longest tokens, backtracking, and a table of pairs that may stand side by side.

``Bpe`` reads a tokenizers file (BPE over a byte-level pre-tokenizer, no dropout) and encodes one pre-token so:

1. An Aho-Corasick automaton over the reversed tokens, run once over the reversed text, gives the longest token that
   starts at each place; the next shorter ones are its prefixes, from a table.
2. Tokens are taken longest first.  A token may follow another only if merging their joined text gives back these two:
   no merge across the border is older than the merges that use up what stands at the border.  The answers for pairs are
   kept in a table.  Where no token fits, the encoder steps back and marks the place, so each place fails at most once
   and the work is linear in the text, also for one word of millions of letters.
3. Exactly one sequence of tokens with compatible neighbours exists, the one that the merges make.

That holds if every merge joins tokens that are older than it and every token is its own encoding; both are checked when
the file is read.  Special tokens are cut out first.  Pre-tokens are those of the library (below U+0250 by its pattern).  Texts are looked up by
the pieces between spaces, of which each process remembers the last ``MOST`` to twice as many, so a piece is encoded
once for its many occurrences.  Decoding copies each id's bytes by a table of offsets into the joined vocabulary.

Null and empty texts have no ids and decode to the empty text; bytes that are no UTF-8 read as U+FFFD, in texts as in ids;
repeated rows and ids, null ids and empty tables give rows as they are.  Only the two named columns are read, so others
may have any name.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, utf8

#: Ids that are decoded at a time.
AT_ONCE = 1 << 16


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes as they are, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens of a tokenizers file: (text in byte letters, id), special tokens, and merges in order of age."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {odd or pre.get('type')}")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens must be plain strings")
        self.ids: dict[str, int] = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


class Decoder:
    """The bytes of ids: one gather through the offsets of the tokens in the joined vocabulary."""

    def __init__(self, path: str):
        v, byte = Vocabulary(path), byte_letters()
        raw = {i: bytes(byte[c] for c in t) for t, i in v.ids.items()} | {i: t.encode() for t, i in v.special.items()}
        size = [len(raw.get(i, b"")) for i in range(max(raw) + 1)]
        self.joined = np.frombuffer(b"".join(raw[i] for i in sorted(raw)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(size)])

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; an id that the vocabulary doesn't have is an error."""
        every, out, utf = np.frombuffer(ids, "<u4"), [], codecs.getincrementaldecoder("utf-8")("replace")
        for a in range(0, len(every), AT_ONCE):
            part = every[a : a + AT_ONCE].astype(np.int64)
            start, n = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            shift = np.repeat(start - (np.cumsum(n) - n), n)
            out.append(utf.decode(self.joined[shift + np.arange(len(shift))].tobytes()))
        return "".join(out) + utf.decode(b"", True)


class Bpe:
    MOST = 200_000

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        v = Vocabulary(path)
        self.library_split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.letters = {b: c for c, b in byte_letters().items()}
        self.special = v.special
        self.cut = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        by_id = {i: t for t, i in v.ids.items()}
        n = max(by_id) + 1
        self.size = [len(by_id.get(i, "")) for i in range(n)]
        #: merge of two ids -> its age; an id's parts; the age of an id as the result of its merge, -1 for single bytes
        self.age_of: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.age = [-1] * n
        for k, (a, b) in enumerate(v.merges):
            x, y, z = v.ids[a], v.ids[b], v.ids[a + b]
            if self.parts[z] is not None or max(self.age[x], self.age[y]) >= k or (self.parts[x] is None and len(a) > 1) or (self.parts[y] is None and len(b) > 1):
                raise ValueError(f"merge {k} doesn't join older tokens into a new one")
            self.age_of[x, y], self.parts[z], self.age[z] = k, (x, y), k
        if any(c not in v.ids for c in byte_letters()) or any(p is None and s > 1 for p, s in zip(self.parts, self.size)):
            raise ValueError("a byte or a merge is missing")
        #: what stands at an id's right and left border over time: (id, age of the merge that uses it up)
        self.right, self.left = [self._border(i, 1) if self.size[i] else [] for i in range(n)], [self._border(i, 0) if self.size[i] else [] for i in range(n)]
        for z, p in enumerate(self.parts):
            if p is not None and not self._apart(*p, before=self.age[z]):
                raise ValueError(f"id {z} isn't its own encoding")
        #: the longest shorter token that an id's text starts with
        self.shorter = [next((i for k in range(len(t) - 1, 0, -1) if (i := v.ids.get(t[:k])) is not None), -1) for t in (by_id.get(i, "") for i in range(n))]
        self.starts = ahocorasick.Automaton()
        for t, i in v.ids.items():
            self.starts.add_word(t[::-1], i)
        self.starts.make_automaton()
        self.table: dict[int, bool] = {}
        self.known: dict[str, bytes] = {t: np.array([i], "<u4").tobytes() for t, i in v.ids.items()}  # each is its own encoding
        self.words, self.new, self.old = {}, {}, {}

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        chain, until = [], len(self.age_of)
        while True:
            chain.append((token, until))
            if self.parts[token] is None:
                return chain
            until = self.age[token]
            token = self.parts[token][side]

    def _apart(self, a: int, b: int, before: int | None = None) -> bool:
        """No merge joins ends of ``a`` and ``b``: while both ends stood there, none was older than what used them up.

        Of equal merges the left one comes first, so the left end goes before a merge of the same age, the right end after.
        """
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                age = self.age_of.get((x, y))
                if age is not None and age < x_until and age <= y_until and (before is None or age < before):
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.table.get(key)
        if got is None:
            if len(self.table) >= self.MOST:
                self.table.clear()
            got = self.table[key] = self._apart(a, b)
        return got

    def merge(self, text: str) -> list[int]:
        """The ids of one pre-token in byte letters."""
        size, shorter, known = self.size, self.shorter, self.table.get
        n, last = len(text), len(text) - 1
        longest = [-1] * n
        for end, token in self.starts.iter(text[::-1]):  # of the tokens that end at a place the longest comes first
            there = longest[last - end]
            if there < 0 or size[token] > size[there]:
                longest[last - end] = token
        out, at, dead = [], 0, bytearray(n + 1)
        before, token = -1, longest[0] if n else -1
        while at < n:
            while token >= 0:
                if not dead[at + size[token]]:
                    if before < 0:
                        break
                    fits = known(before << 32 | token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                before, token = token, longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                before, token = out[-1] if out else -1, shorter[token]
        return out

    #: How the byte-level pre-tokenizer splits texts below U+0250, where letters and digits are the same in all versions.
    LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def _split(self, text: str) -> list[str]:
        """Pre-tokens in byte letters."""
        if text.isascii() or max(text) < "\u0250":
            return [t.encode().decode("latin-1").translate(self.letters) for t in self.LATIN.findall(text)]
        return [t for t, _ in self.library_split(text)]

    def _word(self, token: str) -> bytes:
        got = self.known.get(token) or self.words.get(token)
        if got is None:
            ids = self.merge(token)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(token) <= 256:
                if len(self.words) >= self.MOST:
                    self.words.clear()
                self.words[token] = got
        return got

    def _piece(self, text: str, space: bool = True) -> bytes:
        """The ids of a piece of text after a space (or after none), from memory if it was met before."""
        key = text if space else "  " + text  # no piece after a space starts with two more
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                if text.isascii() and text.isalpha():  # one pre-token
                    got = self._word(self.letters[32] + text if space else text)
                else:
                    got = b"".join(map(self._word, self._split(" " + text if space else text)))
            if len(text) > 256:
                return got
            if len(self.new) >= self.MOST:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got

    #: A space before other text always starts a pre-token, so texts can be cut there.
    GAP = re.compile(r" (?=\S)")

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        found = list(map(self.new.get, rest, repeat(None)))
        if None in found:
            if any(not x or x[0].isspace() for x, y in zip(rest, found) if y is None):
                head, *rest = self.GAP.split(text)
                found = list(map(self.new.get, rest, repeat(None)))
            found = [y if y is not None else self._piece(x) for x, y in zip(rest, found)]
        return (self._piece(head, False) if head else b"") + b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids of a text, 32 bits each, little-endian."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


_made: dict[tuple[type, str], object] = {}


def _of(kind: type, path: str):
    """One encoder or decoder for each worker process."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def _encoded(batches: Iterable[pa.RecordBatch], vocabulary: str, text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches and their texts' ids."""
    bpe = _of(Bpe, vocabulary)
    for batch in slices(batches, text, 4 << 20):
        yield batch, pa.array([bpe.encode(x.decode("utf-8", "replace")) for x in utf8(batch.column(text))], pa.binary())


def _decoded(ids: pa.Array, vocabulary: str) -> pa.Array:
    decoder = _of(Decoder, vocabulary)
    return pa.array([decoder.decode(x) for x in utf8(ids)], pa.string())


def _two(docs: DataFrame, id_col: str, value: str, kind: str) -> tuple[DataFrame, str]:
    """The id and one more column, and the DDL of the id."""
    kept = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{value}`").cast(kind).alias(value))
    return kept, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}"


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): a text's ids as bytes, 32 bits each, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _encoded(batches, vocabulary, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), ids], names=[id_col, "ids"])

    kept, ddl = _two(docs, id_col, text_col, "string")
    return kept.mapInArrow(run, f"{ddl}, ids binary")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of ids as ``encode`` gives them; null ids are those of the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ids_col, 4 << 20):
            ids = batch.column(ids_col)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), ids, _decoded(ids, vocabulary)], names=[id_col, "ids", "text"])

    kept, ddl = _two(encoded, id_col, ids_col, "binary")
    return kept.mapInArrow(run, f"{ddl}, ids binary, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _encoded(batches, vocabulary, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), ids, _decoded(ids, vocabulary)], names=[id_col, "ids", "text"])

    kept, ddl = _two(docs, id_col, text_col, "string")
    return kept.mapInArrow(run, f"{ddl}, ids binary, text string")


def op11_bpe(spark, sf_dir):
    from .packing import default_vocabulary

    both = round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
