"""Licence notices in documents, by a trained paragraph classifier confirmed by templates.

A paragraph (a line of the text, or a run of adjacent lines that holds a hard-wrapped notice) is described by its word 1- to 3-grams, lower-cased; a multinomial logistic
regression over those n-grams, trained in numpy on variations of the templates, on notices of invented licences
(class `unknown`) and on ordinary paragraphs (class `none`), gives its class. Probabilities are calibrated by a
temperature on variations held back from training and on the notices of families that a second and a third model never
saw, whose right class is then `unknown`. A family counts only if the paragraph also holds enough of one of the
family's templates' word pairs, and all of those with a number in them, so that versions are told apart; what looks
like a licence but isn't confirmed is `unknown`. Ordinary paragraphs are sampled from the documents (SAMPLE_LINES lines
from all over each of at most SAMPLE_ROWS texts, SAMPLE_CHARS characters each); all paragraphs of all whole texts are
scanned.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textnp import LOWER, column, gather, mix, owner, piece_hash, runs, slabs, tidy

SAMPLE_ROWS = 300
SAMPLE_LINES, SAMPLE_CHARS = 20, 400
EACH = 60  # variations of each template for training
CONFIRM = 0.6  # share of a template's word pairs that a paragraph must hold
SLAB = 4 << 20
BITS = 1 << 20

#: Short notices of well-known licences (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "Licensed under the LGPL version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["ISC License", "Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "All-rights-reserved": ["All rights reserved.", "Copyright (c) 2020 the authors. All rights reserved."],
}
#: Sentences that hold such words and are no notices.
ORDINARY = ["The driver had to show a license at the border.", "A software program can be free of errors.", "The public road was released from work in April.", "He reserved a table and all seats were taken.", "The general version of the theorem is free.", "Apache helicopters flew over the public park.", "Students at MIT built a source of light.", "The rights of all people are common."]
NONE, UNKNOWN = "none", "unknown"
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
WORD[[ord("-"), ord("+"), ord(".")]] = False


def _grams(data: np.ndarray, off: np.ndarray):
    """n-gram fingerprints of each paragraph: (values, paragraph, order), and words per paragraph. off: the paragraphs' ends."""
    low = LOWER[data]
    s, e = runs(WORD[low], off)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, np.zeros(len(off) - 1, np.int64)
    h, p = piece_hash(low, s, e), owner(off, s)
    vals, pars, order = [h], [p], [np.ones(len(h), np.int64)]
    for n in (2, 3):
        k = np.flatnonzero(p[n - 1 :] == p[: len(p) - n + 1]) if len(p) >= n else np.zeros(0, np.int64)
        v = h[k]
        for j in range(1, n):
            v = mix(v * np.uint64(31) + h[k + j])
        vals.append(v)
        pars.append(p[k])
        order.append(np.full(len(k), n))
    return np.concatenate(vals), np.concatenate(pars), np.concatenate(order), np.bincount(p, minlength=len(off) - 1)


def _flat(texts: list[str]):
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)


def _vary(rng, text: str) -> str:
    w = text.split(" ")
    if len(w) > 5 and rng.random() < 0.5:
        k = int(rng.integers(len(w)))
        w = w[:k] + w[k + 1 :]
    t = " ".join(w)
    r = rng.random()
    t = t.upper() if r < 0.1 else t.lower() if r < 0.25 else t
    if rng.random() < 0.3:
        t = str(rng.choice(["Copyright 2019 ", "Note: ", "This file: ", "# ", "* "])) + t
    return t


#: Frames of notices of licences that don't exist.
FRAMES = [
    "Licensed under the {} License.", "Released under the {} Public License, version {}.", "This work is licensed under the terms of the {} License.", "This software is distributed under the {} license agreement.",
    "Use of this source code is governed by the {} license that can be found in the LICENSE file.", "This file is part of {} and is licensed under its own terms, see LICENSE.", "SPDX-License-Identifier: {}-{}.0", "You may copy and modify this program under the {} License {}.0.",
    "The {} License grants you the right to use and distribute this work.", "Permission is granted by {} to copy this document for any purpose.",
]


def _invented(rng) -> str:
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9)))
    return str(rng.choice(FRAMES)).format("".join(letters).title(), int(rng.integers(1, 6)))


class Scanner:
    """A trained classifier: known n-grams, their weights by class, the temperature."""

    def __init__(self, ordinary: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = [NONE, UNKNOWN, *TEMPLATES]
        texts, y = [], []
        for c, ts in TEMPLATES.items():
            for t in ts:
                texts += [_vary(rng, t) for _ in range(EACH)]
                y += [self.classes.index(c)] * EACH
        texts += [_invented(rng) for _ in range(4 * EACH)]
        y += [1] * 4 * EACH
        plain = [p for t in ordinary for p in t.split("\n") if p.strip() and not re.search(r"(?i)licen|copyright|rights reserved|spdx|public domain", p)]
        texts += plain + ORDINARY * EACH
        y += [0] * (len(plain) + len(ORDINARY) * EACH)
        y = np.array(y)
        held = rng.random(len(y)) < 0.2
        v, p, _, _ = _grams(*_flat(texts))
        z, y_all = [], []
        families = np.arange(2, len(self.classes))
        for gone in (families[0::3], families[1::3], np.zeros(0, np.int64)):  # the last model has seen all families
            unseen = np.isin(y, gone)
            known, w, b, logits = self._fit(v, p, len(texts), y, ~held & ~unseen)
            if len(gone):
                z.append(logits[unseen])
                y_all.append(np.ones(int(unseen.sum()), np.int64))
        self.known = known
        self.held_out = float((logits[held].argmax(1) == y[held]).mean())
        weight = np.concatenate([np.full(len(x), 0.25 / len(x)) for x in z] + [np.full(int(held.sum()), 0.5 / held.sum())])
        z, y_all = np.concatenate([*z, logits[held]]), np.concatenate([*y_all, y[held]])
        loss = {t: -(weight * np.log(self._prob(z / t)[np.arange(len(z)), y_all] + 1e-12)).sum() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)}
        self.heat = min(loss, key=loss.get)
        self.w, self.b = w.astype(np.float32), b.astype(np.float32)
        self.filter = np.zeros(BITS, bool)
        self.filter[(known & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.pairs, self.must = [], []  # of each template: its class and word pairs (of a single word, that), and those with a number
        for c, ts in TEMPLATES.items():
            for t in ts:
                tv, _, to, _ = _grams(*_flat([t]))
                two = tv[to == 2]
                words = re.findall(r"[0-9A-Za-z\x80-\uffff]+", t)
                number = np.array([any(re.fullmatch("[0-9]+", x) for x in q) for q in itertools.pairwise(words)], bool)
                year = np.array(["2020" in q for q in itertools.pairwise(words)], bool)
                self.pairs.append((self.classes.index(c), np.unique(two)))
                self.must.append(np.unique(two[number & ~year]) if len(two) else two)

    def _fit(self, v, p, n, y, use):
        """Weights fitted on the paragraphs in use: (known n-grams, weights, biases, logits of all paragraphs)."""
        lic = np.unique(v[(y[p] > 0) & use[p]])  # others have no say
        at = np.searchsorted(lic, v)
        ok = (at < len(lic)) & (lic[np.minimum(at, len(lic) - 1)] == v)
        at, p = at[ok], p[ok]
        k = len(self.classes)
        x_norm = 1 / np.sqrt(np.maximum(np.bincount(p, minlength=n), 1))
        w, b = np.zeros((len(lic), k)), np.zeros(k)
        b[0] = 1.0
        share = 1 / np.maximum(np.bincount(y[use], minlength=k), 1)[y] * use
        share /= share.sum()
        mw, mb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(150):
            d = self._prob(self._logits(at, p, n, w, b, x_norm))
            d[np.arange(n), y] -= 1
            d *= share[:, None]
            d_row = d * x_norm[:, None]
            g = np.stack([np.bincount(at, d_row[p, c], minlength=len(lic)) for c in range(k)], 1)
            mw, mb = 0.9 * mw + g + 1e-5 * w, 0.9 * mb + d.sum(0)
            w, b = w - 3.0 * mw, b - 3.0 * mb
        return lic, w, b, self._logits(at, p, n, w, b, x_norm)

    @staticmethod
    def _logits(at, p, n, w, b, norm):
        z = np.stack([np.bincount(p, w[at, c], minlength=n) for c in range(w.shape[1])], 1)
        return z * norm[:, None] + b

    @staticmethod
    def _prob(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def scan(self, data: np.ndarray, off: np.ndarray):
        """(paragraph, class, probability) of the paragraphs that hold a notice."""
        v, p, order, _ = _grams(data, off)
        k = np.flatnonzero(self.filter[(v & np.uint64(BITS - 1)).astype(np.int64)])
        v, p, order = v[k], p[k], order[k]
        at = np.minimum(np.searchsorted(self.known, v), len(self.known) - 1)
        ok = self.known[at] == v
        v, p, order, at = v[ok], p[ok], order[ok], at[ok]
        if not len(v):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        ids, q = np.unique(p, return_inverse=True)
        norm = 1 / np.sqrt(np.bincount(q, minlength=len(ids)))
        prob = self._prob(self._logits(at, q, len(ids), self.w, self.b, norm) / self.heat)
        best = prob.argmax(1)
        multi = np.unique(np.stack([q[order > 1].astype(np.uint64), v[order > 1]]), axis=1)[0].astype(np.int64)
        evident = (prob[:, 0] < 0.2) & (np.bincount(multi, minlength=len(ids)) >= 2)  # for no family, more than a word or two
        keep = (best > 0)[q] & (order == 2)
        v, q = v[keep], q[keep]
        proven = np.zeros((len(ids), len(self.classes)))
        for (c, pairs), must in zip(self.pairs, self.must):
            inside = np.isin(v, pairs)
            key, val = np.unique(np.stack([q[inside].astype(np.uint64), v[inside]]), axis=1)
            held = np.bincount(key.astype(np.int64), minlength=len(ids)) / max(1, len(pairs))
            # a version must be there as the template has it
            full = np.bincount(key[np.isin(val, must)].astype(np.int64), minlength=len(ids)) == len(must)
            proven[:, c] = np.maximum(proven[:, c], np.where(full, held, 0))
        sure = proven[np.arange(len(ids)), best] >= CONFIRM
        # a family that the templates bear out better than the predicted one
        other = proven.argmax(1)
        swap = ~sure & (proven.max(1) >= 0.99)
        final = np.where(sure, best, np.where(swap, other, 1))
        hit = np.flatnonzero((best > 0) & ((final > 1) | evident))
        return ids[hit], final[hit], 1 - prob[hit, 0]

    def scan_wrapped(self, data: np.ndarray, off: np.ndarray, row: np.ndarray):
        """scan() of lines, with the notices that run over several adjacent lines of a row; these count at their first line."""
        p, c, prob = self.scan(data, off)
        low = LOWER[data]
        s, e = runs(WORD[low], off)
        if len(s) < 2:
            return p, c, prob
        h, line = piece_hash(low, s, e), owner(off, s)
        near = (np.diff(line) <= 1) & (row[line[1:]] == row[line[:-1]])  # the next word is in the same run of lines
        block = np.concatenate([[0], np.cumsum(~near)])
        pair = mix(h[:-1] * np.uint64(31) + h[1:])
        spans = self._spans(pair, near, block, line)
        if spans:
            a, b = np.array(spans).T
            flat, first, _ = gather(data, s[a], e[b])
            i, fam, sure = self.scan(flat, np.append(first, len(flat)))
            i, fam, sure = i[fam > 1], fam[fam > 1], sure[fam > 1]
            top, end = line[a[i]], line[b[i]]
        else:
            top = end = fam = np.zeros(0, np.int64)
            sure = np.zeros(0)
        # lines that are only parts of these notices don't count again
        whole = np.ones(len(p), bool)
        busy = np.zeros(len(off), bool)
        busy[p] = True
        for x, y, f in zip(top.tolist(), end.tolist(), fam.tolist()):
            u, v = np.searchsorted(p, [x, y + 1])
            whole[u:v] &= (c[u:v] != 1) & (c[u:v] != f)
            busy[x : y + 1] = True
        # other lines that known n-grams join are seen as one
        k = np.flatnonzero(near & (line[1:] != line[:-1]))
        k = k[~busy[line[k]] & ~busy[line[k + 1]]]
        three = lambda q: mix(pair[q] * np.uint64(31) + h[q + 2])
        linked = self._is_known(pair[k])
        left = np.flatnonzero((k > 0) & near[np.maximum(k - 1, 0)])
        linked[left] |= self._is_known(three(k[left] - 1))
        right = np.flatnonzero(k + 2 < len(s))
        right = right[near[k[right] + 1]]
        linked[right] |= self._is_known(three(k[right]))
        join = np.unique(line[k[linked]])  # lines that go on in the next
        if len(join):
            cut = np.flatnonzero(np.diff(join) > 1)
            x, y = join[np.concatenate([[0], cut + 1])], join[np.append(cut, len(join) - 1)] + 1
            flat, first, _ = gather(data, off[x], off[y + 1])
            i, f, q = self.scan(flat, np.append(first, len(flat)))
            top, fam, sure = np.concatenate([top, x[i]]), np.concatenate([fam, f]), np.concatenate([sure, q])
        return np.concatenate([p[whole], top]), np.concatenate([c[whole], fam]), np.concatenate([prob[whole], sure])

    def _is_known(self, v: np.ndarray) -> np.ndarray:
        return self.known[np.minimum(np.searchsorted(self.known, v), len(self.known) - 1)] == v

    def _spans(self, pair, near, block, line) -> list[tuple[int, int]]:
        """Spans of words (first, last) over several lines that hold enough of a template's pairs; of overlapping ones the best."""
        every = np.unique(np.concatenate([x for _, x in self.pairs]))
        code = np.minimum(np.searchsorted(every, pair), len(every) - 1)
        at = np.flatnonzero(near & (every[code] == pair))
        code = code[at]
        found = []
        for _, pairs in self.pairs:
            n = len(pairs)
            member = np.zeros(len(every), bool)
            member[np.searchsorted(every, pairs)] = True
            k = member[code]
            pos, which = at[k], code[k]
            if not len(pos):
                continue
            # words between count as far as the notice stays within twice the template's length
            to = np.minimum(np.searchsorted(pos, pos + 2 * (n + 1)), np.searchsorted(block[pos], block[pos], "right"))
            begin = np.flatnonzero((to - np.arange(len(pos)) >= CONFIRM * n) & (line[pos[to - 1] + 1] > line[pos]))
            for i in begin.tolist():
                seen: set = set()
                last = i
                for j, x in enumerate(which[i : to[i]].tolist(), i):
                    if x not in seen:
                        seen.add(x)
                        last = j
                a, b = int(pos[i]), int(pos[last]) + 1
                if len(seen) >= CONFIRM * n and line[b] > line[a]:
                    found.append((-len(seen) / n, b - a, -n, a, b))
        out: list[tuple[int, int]] = []
        for *_, a, b in sorted(found):
            k = bisect.bisect(out, (a, b))
            if (k == 0 or out[k - 1][1] < a) and (k == len(out) or b < out[k][0]):
                out.insert(k, (a, b))
        return out


def train(df: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Scanner:
    """Fit on the templates and on ordinary lines of at most `rows` documents.

    Null texts are left out; a table without texts trains on the templates alone. Repeated rows and rows with a null
    key may be sampled like others.
    """
    r = F.xxhash64(F.col(key).cast("string"))
    n = max(1, df.count())
    part = df.where(F.col(text).isNotNull() & (F.pmod(r, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 3.0 * rows / n + 20 / n))))
    line = F.array_sort(F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.xxhash64(x, i).alias("h"), F.substring(x, 1, SAMPLE_CHARS).alias("x"))))
    got = part.select(r.alias("r"), F.md5(text).alias("m"), F.col(text)).orderBy("r", "m").limit(rows).select(F.slice(line, 1, SAMPLE_LINES)["x"].alias("t")).collect()
    return Scanner(["\n".join(g.t) for g in got])


def scan(df: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_notices, n_unknown, families, score of every row.

    Paragraphs are the lines that aren't blank; a notice wrapped over several lines counts once. families: the confirmed families, sorted, joined by commas, empty for
    none; n_notices counts lines and runs of lines with a notice, n_unknown those of no confirmed family; score is the highest
    calibrated probability of a notice, 0 for none. Null and empty texts have no paragraphs. Repeated rows stay;
    other columns are not read.
    """
    small_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    @tidy
    def run(batches):
        blank = np.ones(256, bool)
        blank[[0x20, *range(0x09, 0x0E)]] = False
        for b in batches:
            data, off = column(b.column(1))
            n = len(b)
            paras, notices, unknown, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            found: list[set] = [set() for _ in range(n)]
            for i, j in slabs(off, SLAB):
                d = data[off[i] : off[j]]
                if not len(d):
                    continue
                o = off[i : j + 1] - off[i]
                ends = np.unique(np.concatenate([o, np.flatnonzero(d == 0x0A) + 1]))
                row = i + owner(o, ends[:-1])
                full = np.logical_or.reduceat(blank[d], ends[:-1])
                paras[i:j] += np.bincount(row - i, full, minlength=j - i).astype(np.int64)
                p, c, s = scanner.scan_wrapped(d, ends, row)
                for r, x, y in zip(row[p].tolist(), c.tolist(), s.tolist()):
                    notices[r] += 1
                    score[r] = max(score[r], y)
                    if x == 1:
                        unknown[r] += 1
                    else:
                        found[r].add(scanner.classes[x])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paras), pa.array(notices), pa.array(unknown), pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array(np.clip(score, 0, 1))], [doc_id, "n_paragraphs", "n_notices", "n_unknown", "families", "score"])

    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_paragraphs long, n_notices long, n_unknown long, families string, score double")
