"""Licence scan: a trained paragraph classifier, a calibrated unknown class, and template comparison.

The unit is a line.  Multinomial logistic regression over its word 1- to 3-grams tells ``none`` from the licence
families of ``TEMPLATES``.  Training paragraphs come by rule from the templates (parts of them, dropped words, words
around them) and from short marks (``FORMS`` of ``NAMES``); ``none`` is at most ``MOST_LINES`` lines of the corpus without
a template's phrase, of 3 to 2,000 characters, at most ``MOST_MENTIONS`` lines that have a licence's words but no notice, both chosen by hash, and
``HARD``.  Templates, names and sentences are dealt whole into ``FOLDS``; what the folds' models say of those that they
haven't seen sets the temperature of the probabilities and the least probability at which families are right
``PRECISION`` of the time; a licence-like paragraph below it is ``unknown``.  If none does, the largest one tried is taken
with a warning; ``Model.curve`` has (probability, precision, recall) of what was tried.  A predicted family is confirmed if enough of
one of its templates' n-grams, or of the paragraph's own, are shared; else it is unknown as well.

A longer line is judged in the overlapping ``WINDOWS``, so a notice within it isn't diluted;
it has each family that a window has, less those whose shared n-grams another family of the line accounts for.
Paragraphs of several lines (up to a blank one) are also judged in the windows that cross a line break, so a notice may be
wrapped anywhere; a family found so counts for the window's first line, unless a line of the window has it already.

Scoring is one scan of whole texts without a shuffle, however long they are; the model has a bounded vocabulary.  Null or
empty text has no licence line.  Of equal scores the first class counts, families of a line are sorted.  Rows with null or
repeated ids are scored like others.  Input columns named like an added column are replaced by it.  An empty corpus trains
on templates alone and gives no rows.
"""

from __future__ import annotations

import random
import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .common import materialize, slices, table, utf8, without
from .decontaminate import norm_words

MOST_LINES, PRECISION, SHARE, LEAST_SHARED, VARIANTS, LONGEST = 1500, 0.98, 0.6, 5, 60, 3
MOST_MENTIONS, FOLDS, WINDOW, DAMP = 700, 3, 24, 3
#: (words, step) of the windows of longer lines
WINDOWS = ((WINDOW, 8), (12, 4))

#: Usual notices and opening sentences of licences, by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.", "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Public-Domain": ("This work is released into the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."),
    "Proprietary": ("All rights reserved.", "Copyright by the authors. All rights reserved. No part of this work may be reproduced without permission."),
}
#: Sentences about licences that belong to no family, as training for ``unknown``.
OTHER = (
    "Licensed under the terms that the vendor sets out elsewhere.", "Use of this work is governed by a separate license agreement.",
    "This work is licensed for internal use only.", "Released under the Meadow Shared License, version 4.", "See the file COPYING for the license terms.",
)
#: Names of licences in short marks, by family.
NAMES = {
    "Apache-2.0": ("Apache", "Apache-2.0", "Apache 2.0", "Apache License 2.0", "ASL 2.0"),
    "MIT": ("MIT", "MIT/X11", "Expat", "MIT-0"),
    "BSD": ("BSD", "BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause", "New BSD", "Simplified BSD"),
    "GPL": ("GPL", "GPL-3.0", "GPL-2.0", "GPL-3.0-or-later", "GPL-2.0-only", "GPLv3", "GPLv2", "GNU GPL", "GNU General Public"),
    "LGPL": ("LGPL", "LGPL-2.1", "LGPL-3.0", "LGPL-3.0-or-later", "LGPLv3", "GNU LGPL", "GNU Lesser General Public"),
    "AGPL": ("AGPL", "AGPL-3.0", "AGPL-3.0-only", "AGPLv3", "GNU AGPL", "GNU Affero General Public"),
    "MPL-2.0": ("MPL", "MPL-2.0", "MPL 2.0", "Mozilla Public", "Mozilla"),
    "CC-BY": ("CC BY", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution"),
    "CC-BY-SA": ("CC BY-SA", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike"),
    "CC-BY-NC": ("CC BY-NC", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial"),
    "Public-Domain": ("CC0", "CC0-1.0", "CC0 1.0", "Unlicense", "Public Domain"),
    "Proprietary": ("Proprietary", "Commercial Proprietary"),
}
OTHER_NAMES = (
    "Zlib", "EPL-2.0", "NPL-1.1", "RPL-1.5", "EPL 1.0", "Artistic-2.0", "BSL-1.0", "EUPL-1.2", "MS-PL", "OFL-1.1", "PostgreSQL", "Beerware", "SSPL-1.0", "CDDL-1.0", "Sleepycat",
    "Meadow Shared", "Python-2.0", "Vim", "NCSA", "Boost Software", "custom", "Harbour Source", "ODbL", "PHP-3.01", "CC BY-NC-ND 4.0", "CC BY-ND 4.0", "CC-BY-NC-SA-4.0",
)
#: What short marks look like.
FORMS = (
    "{} License", "The {} License", "{} Licence", "{} licensed", "License: {}", "Licence: {}", "License {}", "SPDX-License-Identifier: {}", "Licensed under {}.", "Licensed under the {} License.",
    "Released under {}.", "Released under the {} license.", "Distributed under the {} license", "Available under {} license", "This project is licensed under {}",
)
#: Sentences with a licence's words that are no notices.
HARD = (
    "He lost his driving license in May.", "The council granted a fishing licence to the harbour.", "She studied at MIT before she joined the firm.", "An Apache helicopter landed near the river.",
    "Permission to land was refused by the tower.", "The copyright dispute went on for years.", "Poets take some license with the facts.", "They drove without a license.", "Mit der Bahn in die Stadt.",
    "The rights of the tenants were under review.", "The mozilla foundation hired two people.", "The public domain of the king was sold.", "The pub lost its license to sell beer.", "A licensed doctor must be present.",
    "The creative commons of the village.", "Free software conferences are held each spring.", "Version 2 of the plan was released under pressure.", "The shop was released from its lease.",
)
PHRASE = "(?i)licen[sc]|copyright|rights reserved|public domain|permission is|redistribut|free software"
MENTION = PHRASE + r"|\b(mit|bsd|gnu|apache|mozilla|proprietary|creative commons|permission|version)\b"
#: what makes a line with such words a notice, or too near to one to be an example of none
NOTICE = re.compile(r"(?i)(licen[sc]ed|released|distributed|available|provided|published|covered) (under|by)|spdx|licen[sc]e\s*[:=]|rights reserved|copyright\s*(\(c\)|©|\d)|permission is|redistribut|free software|public domain|licen[sc]e\W*$|licen[sc]e,? (version|v)|^\W*licen[sc]e\b|governed by|terms of")
UNKNOWN, NONE = "unknown", "none"
CLASSES = (NONE, UNKNOWN, *TEMPLATES)


def grams(ws: list[bytes], longest: int = LONGEST) -> set[bytes]:
    return {b" ".join(ws[k : k + n]) for n in range(1, longest + 1) for k in range(len(ws) - n + 1)}


def sources() -> list[tuple[int, str, list[str]]]:
    """(class, template or name, its texts): what folds hold out whole."""
    out = [(1, t, [t]) for t in OTHER] + [(1, n, [f.format(n) for f in FORMS]) for n in OTHER_NAMES]
    for k, family in enumerate(TEMPLATES):
        out += [(k + 2, t, [t]) for t in TEMPLATES[family]] + [(k + 2, n, [f.format(n) for f in FORMS]) for n in NAMES[family]]
    return out


def fold(source: str) -> int:
    return zlib.crc32(source.encode()) % FOLDS


def examples(lines: list[bytes], mentions: list[bytes] = (), seed: int = 11) -> list[tuple[list[bytes], int, int]]:
    """(words, class, fold) for training: variants of templates and marks by rule; as ``none``, corpus lines and ``HARD``."""
    rng = random.Random(seed)
    around = [w for x in lines for w in norm_words(x)] or [b"text"]
    pad = lambda most: [rng.choice(around) for _ in range(rng.choice((0, 0, 1, 4, most, rng.randint(4, most))))]
    out = [(norm_words(x), 0, k % FOLDS) for k, x in enumerate([*lines, *mentions])]
    out += [(ws[a : a + WINDOW], 0, k % FOLDS) for k, x in enumerate(mentions) if (ws := norm_words(x)) for a in [rng.randrange(len(ws))]]
    parts = [ws for x in lines if (ws := norm_words(x))]
    for k in range(MOST_LINES if parts else 0):  # windows of prose, however few lines there are
        ws, n = rng.choice(parts), rng.randint(3, WINDOW)
        a = rng.randrange(max(1, len(ws) - n + 1))
        out.append((ws[a : a + n], 0, k % FOLDS))
    telling = {w for names in NAMES.values() for n in names for w in norm_words(n.encode())}
    whole = [(c, grams(norm_words(t.encode()))) for c, _, texts in sources() if c > 1 for t in texts if len(texts) == 1]
    # a single word of a notice is none
    single = {w for _, _, texts in sources() for t in texts for w in norm_words(t.encode())}
    out += [([w], 0, fold(str(w))) for w in sorted(single) for _ in range(48 if w in telling else 4)]
    for t in HARD:
        out += [(pad(12) + norm_words(t.encode()) + pad(12), 0, fold(t)) for _ in range(VARIANTS // 3)]
    for c, name, texts in sources():
        for text in texts:
            ws = norm_words(text.encode())
            out.append((ws, c, fold(name)))
            names = NAMES.get(CLASSES[c], ())
            for _ in range(VARIANTS if len(texts) == 1 else 1 if c == 1 else max(2, 16 // len(names)) * (3 if name == names[0] else 1)):
                a = rng.randint(0, max(0, len(ws) - 8)) if len(ws) > 12 else 0
                part = ws[a : a + rng.randint(8, len(ws))] if len(ws) > 12 else ws
                part = [w for w in part if w in telling or rng.random() > 0.05]
                if not any(c != o and grams(part) <= t for o, t in whole):  # what two families have in common tells nothing
                    out.append((pad(12) + part + pad(12), c, fold(name)))
    return out


class Model:
    """Weights by n-gram, temperature and least probability, and the templates' n-grams."""

    def __init__(self, vocab: dict[bytes, int], w: np.ndarray, b: np.ndarray, heat: float = 1.0, least: float = 0.5, held: int | None = None, common: Counter | None = None):
        self.vocab, self.w, self.b, self.heat, self.least = vocab, w.astype(np.float32), b, heat, least
        self.curve: list[tuple[float, float, float]] = []
        self.templates = {f: [] for f in TEMPLATES}
        for c, name, texts in sources():
            if c > 1 and fold(name) != held:
                self.templates[CLASSES[c]] += [grams(norm_words(t.encode())) for t in texts]
        #: words of a family's templates that no other family has
        words = {f: {x for t in ts for x in t if b" " not in x} for f, ts in self.templates.items()}
        self.own = {f: ws.difference(*(words[o] for o in words if o != f)) for f, ws in words.items()}
        #: the most that n-grams can add to a class above none, each counted with its rarest word
        common, tops = common or Counter(), {}
        for g, k in vocab.items():
            at = min(g.split(), key=lambda x: (common[x], x))
            tops[at] = np.maximum(tops.get(at, 0.0), 0.0) + np.maximum(w[k, 1:] - w[k, 0], 0.0)
        self.top = {x: float(top.max()) for x, top in tops.items()}
        self.floor = float((b[0] - b[1:]).min()) - 1e-3  # less the error of 32-bit weights
        #: of d other words none can add more than floor * sqrt(3 / WINDOW), so a window of them, with 3 d - 3 + DAMP n-grams or more, is none
        self.needed = {x for x, top in self.top.items() if top >= self.floor * (3 / WINDOW) ** 0.5}
        self.seen: dict[bytes, tuple[str, float]] = {}

    def shared(self, family: str, g: set[bytes]) -> set[bytes]:
        """The n-grams that ``g`` shares with the templates of a family that confirm it."""
        out: set[bytes] = set()
        for t in self.templates[family]:
            both = g & t
            if len(both) >= max(min(LEAST_SHARED, len(t)), SHARE * min(len(t), len(g))):
                own = self.own[family] & t
                if not own or own & both:
                    out |= both
        return out

    def confirmed(self, family: str, g: set[bytes]) -> bool:
        """Whether templates of the family share enough, and no other family's share all of that and more."""
        mine = self.shared(family, g)
        return bool(mine) and not any(mine < self.shared(o, g) for o in self.templates if o != family)

    def scores(self, g: set[bytes]) -> np.ndarray:
        at = [k for x in g if (k := self.vocab.get(x)) is not None]
        return self.w[at].sum(axis=0) / (len(g) + DAMP) ** 0.5 + self.b

    def _words(self, ws: list[bytes]) -> tuple[str, float]:
        key = b" ".join(ws) if len(ws) < 60 else b""
        if key and (got := self.seen.get(key)):
            return got
        g = grams(ws)
        p = linear.softmax(self.scores(g) / self.heat)
        best = int(p.argmax())
        family = CLASSES[best]
        if best > 1 and (p[best] < self.least or not self.confirmed(family, g)):
            family = UNKNOWN if p[0] < 0.5 else NONE
        if len(self.seen) < 50_000 and key:
            self.seen[key] = (family, float(p[best]))
        return family, float(p[best])

    def judge(self, line: bytes) -> tuple[str, float]:
        """(family, unknown or none; its probability) of a line as a whole."""
        return self._words(norm_words(line))

    def families(self, line: bytes) -> list[str]:
        """The families of a line's windows, sorted; ``[unknown]`` if it has only unknown ones, ``[]`` if none."""
        ws = norm_words(line)
        if self.floor > 0 and self.needed.isdisjoint(ws):
            return []
        places = [k for k, w in enumerate(ws) if self.floor <= 0 or w in self.needed]
        found = []
        for size, step in WINDOWS:
            size = min(size, len(ws))
            starts = {min(a, len(ws) - size) for k in places for a in range(max(0, -(-(k - size + 1) // step)) * step, k + 1, step)}
            for a in sorted(starts):
                x = ws[a : a + size]
                words = set(x)
                if sum([self.top.get(w, 0.0) for w in words]) >= self.floor * (max(1, 3 * len(words) - 3) + DAMP) ** 0.5 and (f := self._words(x)[0]) != NONE:
                    found.append((f, x))
        if not found:
            return []
        known: dict[str, set[bytes]] = {}
        for f, x in found:
            if f != UNKNOWN:
                known[f] = known.get(f, set()) | self.shared(f, grams(x))
        # part of one family's notice may read like another's; then it shares no n-grams of its own with the other
        kept = [f for f in known if not any(f != o and known[f] < known[o] for o in known)]
        return sorted(kept) or ([UNKNOWN] if found else [])


    def document(self, text: bytes) -> tuple[int, list[tuple[int, list[str]]]]:
        """The number of lines, and (line, its families) of those that have any."""
        lines = text.split(b"\n")
        got = {k: fs for k, x in enumerate(lines) if (fs := self.families(x))}
        if self.floor <= 0 or not self.needed.isdisjoint(norm_words(text)):
            first = 0
            for k in range(len(lines) + 1):
                if k == len(lines) or not lines[k].strip():
                    if k - first > 1:
                        self._wrapped(lines[first:k], first, got)
                    first = k + 1
        return len(lines), sorted(got.items())

    def _wrapped(self, lines: list[bytes], first: int, got: dict[int, list[str]]) -> None:
        """Adds the families of windows that cross a break between ``lines``, of which ``first`` is the number of the first."""
        split = [norm_words(x) for x in lines]
        ws, of = [w for x in split for w in x], [first + k for k, x in enumerate(split) for _ in x]
        size, step = min(WINDOWS[0][0], len(ws)), WINDOWS[0][1]
        places = [k for k, w in enumerate(ws) if self.floor <= 0 or w in self.needed]
        for a in sorted({min(a, len(ws) - size) for k in places for a in range(max(0, -(-(k - size + 1) // step)) * step, k + 1, step)}):
            if of[a] == of[a + size - 1]:
                continue
            x = ws[a : a + size]
            words = set(x)
            if sum([self.top.get(w, 0.0) for w in words]) >= self.floor * (max(1, 3 * len(words) - 3) + DAMP) ** 0.5:
                f = self._words(x)[0]
                if f in (NONE, UNKNOWN):
                    continue
                inside = range(of[a], of[a + size - 1] + 1)
                for k in inside:  # what reads like some licence on its own line is part of this one
                    if got.get(k) == [UNKNOWN]:
                        del got[k]
                if not any(f in got.get(k, ()) for k in inside):
                    got[of[a]] = sorted({f, *got.get(of[a], ())})


def fit(rows: list[tuple[list[bytes], int, int]]) -> Model:
    """The model of all examples, calibrated by models that lack one fold each."""
    sets = [grams(ws) for ws, _, _ in rows]
    y, folds = np.array([c for _, c, _ in rows]), np.array([f for _, _, f in rows])

    # n-grams of notices and of hard negatives, but not of the words around them
    allowed = {g for _, _, texts in sources() for t in texts for g in grams(norm_words(t.encode()))} | {g for t in HARD for g in grams(norm_words(t.encode()))}

    def part(inside: np.ndarray, held: int | None) -> Model:
        df: dict[bytes, int] = {}
        for k in np.flatnonzero(inside):
            for g in sets[k] & allowed:
                df[g] = df.get(g, 0) + 1
        vocab = {g: k for k, g in enumerate(sorted(g for g, n in df.items() if n >= 15))}
        at = np.flatnonzero(inside)
        x = np.zeros((len(at), len(vocab)), np.float64)
        for row, k in enumerate(at):
            x[row, [vocab[g] for g in sets[k] if g in vocab]] = 1 / (len(sets[k]) + DAMP) ** 0.5
        return Model(vocab, *linear.softmax_fit(x, y[at], len(CLASSES), l2=0.02, steps=250), held=held, common=common)

    common = Counter(w for ws, c, _ in rows if c == 0 for w in ws)
    z = np.zeros((len(rows), len(CLASSES)))
    fine = np.zeros(len(rows), bool)
    for f in range(FOLDS):
        m = part(folds != f, f)
        for k in np.flatnonzero(folds == f):
            z[k] = m.scores(sets[k])
            best = int(z[k].argmax())
            fine[k] = best > 1 and m.confirmed(CLASSES[best], sets[k])
    model = part(np.ones(len(rows), bool), None)
    model.heat = linear.temperature(z, y)
    p = linear.softmax(z / model.heat)
    best = p.argmax(axis=1)
    right, named = best == y, y > 1
    for c in np.linspace(0.3, 0.95, 27):
        sure = fine & (p.max(axis=1) >= c)
        model.curve.append((float(c), float(right[sure].mean()) if sure.any() else 0.0, float((right & sure & named).sum() / max(named.sum(), 1))))
    good = [c for c, precision, _ in model.curve if precision >= PRECISION]
    model.least = good[0] if good else model.curve[-1][0]
    if not good:
        warnings.warn(f"no probability gives held-out precision {PRECISION}; at {model.least:.2f} it is {model.curve[-1][1]:.3f} with recall {model.curve[-1][2]:.3f}", stacklevel=2)
    return model


def train(docs: DataFrame, text_col: str = "text", most_lines: int = MOST_LINES, most_mentions: int = MOST_MENTIONS) -> Model:
    line = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    lines = docs.select(line.alias("line")).filter(F.length("line").between(3, 2000))
    # a slice of the hash range that holds enough lines (a document has one at least), so that little is sorted or sent
    share = min(1.0, 20 * most_lines / max(docs.count(), 1))
    lines = lines.withColumn("h", F.xxhash64("line")).filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    lines = materialize(lines.groupBy("h").agg(F.min("line").alias("line")), "licence-lines")
    first = lambda which, most: [r.line for r in lines.filter(which).orderBy("h").limit(most).collect()]
    plain = first((F.length("line") >= 20) & ~F.col("line").rlike(PHRASE), most_lines)
    mentions = [x for x in first(F.col("line").rlike(MENTION), most_mentions) if not NOTICE.search(x)]
    return fit(examples([x.encode() for x in plain], [x.encode() for x in mentions]))


FOUND = "n_lines long, n_licence long, n_unknown long, families string, spans string"


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_licence and n_unknown paragraphs, families (sorted, comma-joined), spans (family:line)."""
    fields = T.StructType.fromDDL(FOUND)
    docs = without(docs, *fields.names)
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document = shared.value.document
        for batch in slices(batches, text_col):
            rows = []
            for text in utf8(batch.column(text_col)):
                n, got = document(text)
                sure = [fs for _, fs in got if fs != [UNKNOWN]]
                rows.append((n, len(sure), len(got) - len(sure), ",".join(sorted({f for fs in sure for f in fs})), ",".join(f"{f}:{k}" for k, fs in got for f in fs)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[*names, *fields.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields.fields]))


def op1_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs)).select("doc_id", "n_lines", "n_licence", "n_unknown", "families", "spans")
