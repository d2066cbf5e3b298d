"""Licence scanning: a classifier of paragraphs over word n-grams, confirmed by comparing with templates.

Paragraphs are lines, and longer ones windows of WINDOW words, half of which overlap. Those that share fewer than two word pairs with
the templates are unknown. A multinomial logistic regression over hashed words and word pairs tells the licence families and `unknown`
for the others. It is trained on variants of the templates and, for `unknown`, on a bounded sample of the corpus's own windows and on
notices of licences that no family is, made from the templates by other names and versions. Its probabilities are calibrated by a
temperature fitted on every fourth example, unknown notices among them. A family counts as confirmed when the paragraph shares enough
of its word pairs with one of its templates, pairs that few families have counting more."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, table

BITS, WINDOW, SAMPLE, VARIANTS, STEPS = 18, 48, 4000, 40, 150
PROBABILITY, SIMILARITY, PAIRS = 0.5, 0.6, 2
UNKNOWN = "unknown"
#: How texts name licences, by family; a notice is made of each name.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "EPL v1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "EPL v2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "CDDL 1.0"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["Do What The F*ck You Want To Public License", "WTFPL"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "EUPL-1.2": ["European Union Public Licence, version 1.2", "EUPL 1.2"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "OFL 1.1"],
    "CC0-1.0": ["Creative Commons Zero 1.0 Universal", "CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY 4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA 4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC 4.0"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND 4.0"],
    "CC-BY-NC-SA": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC-SA 4.0"],
    "CC-BY-NC-ND": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0", "CC-BY-NC-ND 4.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License"],
    "MS-PL": ["Microsoft Public License", "Ms-PL"],
    "ODbL-1.0": ["Open Database License v1.0", "ODbL 1.0"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA License"],
}
#: Sentences of the licences' own notices.
NOTICES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "GPL-2.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: How notices begin.
LEADS = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the {}.", "SPDX-License-Identifier: {}", "{}")
TEMPLATES = {f: [LEADS[(k + j) % 4].format(n) for k, n in enumerate(names) for j in range(4)] + names + NOTICES.get(f, []) for f, names in NAMES.items()}
_WORD = re.compile(r"[\w.+-]*\w")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows(text: str | None):
    """(paragraph's number, first word, words) of each paragraph's windows; paragraphs without words have none."""
    for k, line in enumerate((text or "").split("\n")):
        words = words_of(line)
        for s in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2) if words else ():
            yield k, s, words[s : s + WINDOW]


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 600_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) | 1 << 32
        return h


def slots(words: list[str], of: dict) -> np.ndarray:
    """Hashed slots of the words and pairs of words of a paragraph."""
    h = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mix = np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), (pairs ^ pairs >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)])
    return (mix >> np.uint64(64 - BITS)).astype(np.int64)


def pairs_of(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:])) or frozenset((w,) for w in words)


def _weights() -> dict:
    """The weight of each word pair of the templates: less, the more families have it."""
    has: dict = {}
    for family, texts in TEMPLATES.items():
        for t in texts:
            for p in pairs_of(words_of(t)):
                has.setdefault(p, set()).add(family)
    return {p: 1 / len(f) for p, f in has.items()}


class Classifier:
    """weights: slots x classes; classes[0] is unknown."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature
        self.templates = [[], *([pairs_of(words_of(t)) for t in TEMPLATES[c]] for c in classes[1:])]
        self.pair_weights = _weights()
        of = _Hashes()
        self.seen = np.zeros(1 << BITS, bool)  # slots of the templates' pairs
        for ts in TEMPLATES.values():
            for t in ts:
                words = words_of(t)
                self.seen[slots(words, of)[len(words) :] if len(words) > 1 else slots(words, of)] = True

    def worth(self, rows: list[np.ndarray]) -> np.ndarray:
        """Whether windows share PAIRS word pairs with the templates, or all the pairs they have."""
        return np.array([int(self.seen[r[(n := (len(r) + 1) // 2) :] if len(r) > 1 else r].sum()) >= min(PAIRS, max(1, len(r) - n if len(r) > 1 else 1)) for r in rows], bool)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        z = (np.add.reduceat(self.weights[np.concatenate(rows)], first) + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def similarity(self, c: int, words: list[str]) -> tuple[int, float]:
        """The template of a family that is most like the paragraph's best stretch of its length: the weight of the pairs that both
        have, as a part of the weight of all pairs of the longer of both. Pairs of no template weigh as those of one family."""
        best, weight = (0, 0.0), self.pair_weights
        for k, t in enumerate(self.templates[c]):
            own_all, size = list(zip(words, words[1:])) or [(w,) for w in words], max(1, len(t))
            starts = range(0, max(1, len(own_all) - size + 1))
            hits = np.concatenate([[0], np.cumsum([weight.get(p, 1.0) if p in t else 0.0 for p in own_all])])
            s = max(starts, key=lambda s: hits[min(s + size, len(own_all))] - hits[s])
            own = frozenset(own_all[s : s + size])
            total = lambda ps: sum(weight.get(p, 1.0) for p in ps)
            share = total(own & t) / max(total(own), total(t))
            best = max(best, (k, share), key=lambda x: x[1])
        return best


def _variants(rng) -> list[tuple[list[str], str]]:
    """Template texts with words dropped, cut at the ends, or with a name before or a year behind."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            out += [(words, family)] * 3
            for _ in range(max(2, VARIANTS // len(texts))):
                keep = [w for w in words if rng.random() > 0.08] if len(words) > 8 else words
                keep = keep[: len(keep) - int(rng.integers(0, max(1, len(keep) // 5)))] if len(words) > 12 else keep
                before = ["copyright", str(int(rng.integers(1990, 2030))), _name(rng)] if rng.random() < 0.3 else [_name(rng) for _ in range(int(rng.integers(0, 4)))] if rng.random() < 0.3 else []
                out.append((before + keep, family))
    return out


def _name(rng) -> str:
    return "".join("aeiou"[int(rng.integers(5))] if k % 2 else "bdfgklmnprstvz"[int(rng.integers(14))] for k in range(int(rng.integers(4, 9))))


def _others(rng, many: int) -> list[list[str]]:
    """Notices of licences that no family is: other names and versions in the families' forms."""
    out = []
    for _ in range(many):
        name, kind = _name(rng), rng.integers(6)
        version = f"{int(rng.integers(1, 9))}.{int(rng.integers(0, 10))}"
        text = (f"{name} License", f"{name} Public License, Version {version}", f"GNU {name} License, version {int(rng.integers(4, 9))}", f"CC {name} {version}", f"{name}-{version}", f"{name} Software License {version}")[kind]
        out.append(words_of(LEADS[int(rng.integers(len(LEADS)))].format(text)))
    return out


def train(unknown: list[list[str]]) -> Classifier:
    """unknown: words of windows of the corpus; those that share much of a template's pairs are left out."""
    rng, of = np.random.default_rng(3), _Hashes()
    templates = [pairs_of(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    unknown = [w for w in unknown if w and max(len((o := pairs_of(w)) & t) / len(t) for t in templates) < 0.3]
    generic = [words_of(t) for t in ("all rights reserved", "this work is described in the version above", "released in the spring", "see the terms of use", "public general information")]
    examples = _variants(rng) + [(w, UNKNOWN) for w in unknown + generic * 4 + _others(rng, 1500)]
    examples = [examples[k] for k in rng.permutation(len(examples))]
    classes = [UNKNOWN, *TEMPLATES]
    rows, y = [slots(w, of) for w, _ in examples], np.array([classes.index(c) for _, c in examples])
    used, ids = np.unique(np.concatenate(rows), return_inverse=True)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    held = np.arange(len(rows)) % 4 == 3
    w, b, sq = np.zeros((len(used), len(classes))), np.zeros(len(classes)), np.full((len(used), len(classes)), 1e-3)
    balance = (1 / np.bincount(y[~held], minlength=len(classes)).clip(1))[y] * (~held)
    balance[y == 0] *= 4
    balance /= balance.sum()
    hot = np.eye(len(classes))[y]
    for _ in range(STEPS):  # Adagrad on all examples
        z = np.add.reduceat(w[ids], first) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        err = (p / p.sum(axis=1, keepdims=True) - hot) * balance[:, None]
        grad = np.stack([np.bincount(ids, err[row_of, c], len(used)) for c in range(len(classes))], axis=1) + 1e-5 * w
        sq += grad**2
        w -= 0.3 * grad / np.sqrt(sq)
        b -= 2.0 * err.sum(axis=0)
    z = (np.add.reduceat(w[ids], first) + b)[held]
    losses = {}
    for t in np.geomspace(0.25, 4, 33):
        p = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        losses[float(t)] = -np.log((p / p.sum(axis=1, keepdims=True))[np.arange(len(z)), y[held]].clip(1e-12)).mean()
    full = np.zeros((1 << BITS, len(classes)), np.float32)
    full[used] = w
    return Classifier(classes, full, b.astype(np.float32), min(losses, key=losses.get))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each window of a paragraph that is told as a licence: id, paragraph (from 0), first_word, n_words, family,
    probability, template (its number in the family), similarity, confirmed.

    All paragraphs of all texts are read. `unknown` is learnt from SAMPLE documents picked by a hash of id and text, a window of each, picked
    likewise. Null and empty texts have no paragraphs; rows that repeat an id each have theirs; an empty table gives an empty result."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = least_hashed(rows.filter("length(text) > 0").withColumn("h", F.xxhash64("id", "text")), F.col("h"), SAMPLE, None, "id")

    def window(batches):
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                if parts := list(windows(t.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([parts[h % len(parts)][2]])], names=["h", "words"])

    sample = picked.select("h", "text").mapInArrow(window, "h long, words array<string>").toArrow().sort_by("h")  # SAMPLE rows of WINDOW words at most
    model = spark.sparkContext.broadcast(train(sample["words"].to_pylist()))

    def run(batches):
        m, of = model.value, _Hashes()
        for b in batches:
            out = []
            for k in range(b.num_rows):
                parts = list(windows(b.column(1)[k].as_py()))
                for at in range(0, len(parts), 512):
                    some = parts[at : at + 512]
                    found = [slots(w, of) for _, _, w in some]
                    worth = np.flatnonzero(m.worth(found)).tolist()
                    if not worth:
                        continue
                    some, p = [some[j] for j in worth], m.probabilities([found[j] for j in worth])
                    best = p.argmax(axis=1)
                    for j in np.flatnonzero((best > 0) & (p.max(axis=1) >= PROBABILITY)).tolist():
                        (para, s, words), c = some[j], int(best[j])
                        t, share = m.similarity(c, words)
                        out.append((k, para, s, len(words), m.classes[c], round(float(p[j, c]), 6), t, share, share >= SIMILARITY))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([o[0] for o in out])), *(pa.array([o[j + 1] for o in out], t) for j, t in enumerate(types))], names=["id", "paragraph", "first_word", "n_words", "family", "probability", "template", "similarity", "confirmed"])

    return rows.mapInArrow(run, f"id {kind}, paragraph long, first_word long, n_words long, family string, probability double, template long, similarity double, confirmed boolean").withColumnRenamed("id", id_col)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
