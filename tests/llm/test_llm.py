"""The corpus operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import base64
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import decontamination, embedding_dedup, jaccard_join, language_id, license_scan, queries, sentencepiece_bpe, sharding, suffix_dedup, token_counts, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n int, h string, g string, item string"  # with names that the operators use inside


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", "z") for i, t in texts], DOCS).repartition(3)


def mixed(seed=1, n=40):
    """Texts with copies, near copies, shared passages, odd ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(30)
    out = [None, "", " ", "\n\t", "a", "Ab c", "x " * 300, "ééé" * 50, "A" * 500, "A" * 520]
    base = [text(rng.randint(3, 120)) for _ in range(n)]
    out += base + [base[3]] * 3 + [base[4].upper()]
    for b in base[:12]:
        w = b.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [text(10) + " " + passage + " " + text(5) for _ in range(5)] + ["▁ x" + passage, text(20000 // 6)]
    rng.shuffle(out)
    return list(enumerate(out, 100))


def sets_of(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def smallest(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard_against_all_pairs(spark, k=4, num=85):
    rows = mixed(k)
    s = {i: sets_of(t, k) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    want = smallest(s, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs(spark, rows), k, num, 100).collect()}
    assert got == {i: (len(s[i]), want[i]) for i in s} and len(links) > 10


def test_keep_one_of_repeated_rows(spark):
    a, b = "a b c d e f g h " * 3, "p q r s t u v w " * 3
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b + "z"), (3, b), (3, None), (4, "x"), (None, a), (None, a), (5, None), (5, None)]
    kept = jaccard_join.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (3, b), (4, "x"), (None, a), (None, a), (5, None)], key=repr)


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = []
    for _ in range(120):
        n = int(rng.integers(20, 400))
        v = np.unique(np.where(rng.random(n) < rng.choice([0.02, 0.2]), rng.integers(0, 1 << 62, n).astype(np.uint64), base[:n]))
        sets.append(v)
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig = jaccard_join.signatures(np.concatenate(sets), off)
    a, b = jaccard_join.block_pairs([len(x) for x in sets], sig, np.arange(len(sets)), 85, 100)
    found = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    true = {frozenset((i, j)) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert true <= found and len(true) > 20 and len(found) < 120 * 119 // 4


def removed(rows, least):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            first[b[p : p + least]] = min(first.get(b[p : p + least], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        c = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                c[p : p + least] = b"\1" * least
        out[i] = (b, c)
    return out


def test_suffix_dedup_against_brute_force(spark):
    rows = mixed(7)
    want = {i: (len(b), sum(c), sum(1 for k in range(len(c)) if c[k] and not (k and c[k - 1])), hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest()) for i, (b, c) in removed(rows, 50).items()}
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs(spark, rows)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500
    kept = suffix_dedup.remove_repeats(docs(spark, rows), 100)
    assert kept.columns == docs(spark, []).columns
    cut = {i: (b, c) for i, (b, c) in removed(rows, 100).items()}
    for r in kept.collect():
        b, c = cut[r.doc_id]
        if not sum(c):
            assert r.text == dict(rows)[r.doc_id]
        else:
            assert len(r.text.encode()) <= len(b) - sum(c)


def test_suffix_ranks_of_parts(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (900, 30, 49, 50, 51, 400, 0)]
    blob = suffix_dedup._zip(pa.table({"id": pa.array(range(7), pa.int64()), "text": texts}))

    def windows():
        m, s, e, r = suffix_dedup.Stretches(blob, 50).anchors(20)
        return {(int(k), w): int(v) for v, a, b, k in zip(m, s, e, r) for w in range(a, b)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 49) for t in texts)
    for size in (60, 128, 333):
        monkeypatch.setattr(suffix_dedup, "SLAB", size)
        assert windows() == whole
    # the pair of the ranks at offsets 0 and h is the rank of 2h
    d = np.frombuffer(texts[0].encode(), np.uint8)
    a = suffix_dedup.names(d, 16)
    assert (suffix_dedup.names(d, 32) == suffix_dedup._double(a[:-16], a[16:])).all()


def test_suffix_dedup_of_long_and_odd_rows(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) + 300_000))
    cut = base[(1 << 20) - 100 : (1 << 20) + 100]
    rows = [(-(1 << 63), base), (5, "Q" * 40 + cut + "Z" * 40), (6, cut), (6, cut), (None, cut), (7, None), (8, "")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(docs(spark, rows)).collect()), key=repr)
    assert got == sorted([(-(1 << 63), len(base), 0, 0), (5, 280, 200, 1), (6, 200, 200, 1), (6, 200, 200, 1), (None, 200, 0, 0), (7, 0, 0, 0), (8, 0, 0, 0)], key=repr)
    kept = {(r.doc_id, r.text) for r in suffix_dedup.remove_repeats(docs(spark, rows), 100).collect()}
    assert kept == {(-(1 << 63), base), (5, "Q" * 40 + "Z" * 40), (6, ""), (None, cut), (7, None), (8, "")}
    assert suffix_dedup.remove_repeats(docs(spark, rows).limit(0)).count() == 0


def test_pipeline_run(spark, tmp_path):
    import corpus_pipeline

    text = "some plain words about a house and a garden that nobody has seen for many years "
    rows = [(1, text * 3, "en", "s", len(text) * 3, 0.77), (2, text * 3, "en", "s", len(text) * 3, 0.5), (3, "", "en", "s", 0, 0.1), (4, None, None, "s", 0, 0.1), (None, "Wort und noch ein Wort", "de", "s", 22, 0.2), (5, "12 34", "de", "s", 5, 0.2), (5, "12 34", "de", "s", 5, 0.2)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double"
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    for name, some in (("full", rows), ("empty", [])):
        d = spark.createDataFrame(some, kind)
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.limit(len(some)).write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()
    assert sorted(repr(r.doc_id) for r in got) == ["1", "None"] and all(r.n_tokens > 0 for r in got)
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "full" / "documents.parquet")), "")
    assert first.columns[-1] == "score" and {r.doc_id: r.score for r in first.collect()}[1] == 0.77
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("anchors, size", [(20_000, 64 << 20), (0, 64 << 20), (0, 0)])
def test_decontamination_against_brute_force(spark, monkeypatch, anchors, size):
    monkeypatch.setattr(decontamination, "MAX_ANCHORS", anchors)
    monkeypatch.setattr(decontamination, "MAX_BYTES", size)
    rows = mixed(9)
    text = dict(rows)
    long = [t for t in text.values() if t and len(t.split()) > 30]
    items = [(1, " ".join(long[0].split()[2:22])), (2, "Zzz " + " ".join(long[1].split()[:14])), (3, long[2].split()[3]), (4, ""), (5, None), (10, " ".join(long[0].split()[2:22])), (None, long[3])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {(tuple(w[i : i + 13]), k) for k, t in items if k is not None and (w := words(t)) for i in range(max(1, len(w) - 12))}
    want = {}
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for win, k in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(str(k))
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.score(docs(spark, rows), bench).collect()}
    assert got == want and any(x[4] for x in want.values())
    kept = decontamination.remove_documents(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[4]} and kept.columns == docs(spark, []).columns
    assert decontamination.score(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    clash = docs(spark, rows).withColumnsRenamed({"h": "__h", "n": "__n", "g": "__gone"})
    clean = decontamination.remove_spans(clash, bench)
    assert clean.columns == [*clash.columns, "clean_text"]
    for r in clean.collect():
        assert (r["__h"], r["__n"], r["__gone"]) == ("x", 1, "y")
        assert (r.clean_text is None) == (r.text is None) and len((r.clean_text or "").split()) == want[r.doc_id][0] - want[r.doc_id][1]


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    rows = mixed(3) + [(1000, "<s> </s> <0x0A>"), (1001, "a▁ b"), (1002, "\x00é日本😀ﬁ"), (1003, "ab" * 700), (1004, "   x   ")]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(e := sp.encode(t or "")), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in rows}
    got = {r.doc_id: tuple(r)[1:] for r in sentencepiece_bpe.round_trip(docs(spark, rows)).collect()}
    assert got == want
    full = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs(spark, rows)))
    for r in full.collect():
        assert r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids)


def test_token_counts_against_plain_dynamic_programming(monkeypatch):
    p, u = token_counts.zipf_pieces(sentencepiece_bpe.default_model()), token_counts.unigram(sentencepiece_bpe.default_model())

    def plain(t):
        n = 0
        for w in re.split("[ \t-\r]+", t or ""):
            if w:
                w, best = "▁" + w, [(0.0, 0)]
                for i in range(1, len(w) + 1):
                    c = [(best[k][0] + p[w[k:i]], best[k][1] - 1) for k in range(max(0, i - 16), i) if w[k:i] in p]
                    if w[i - 1] not in p:
                        z = len(w[i - 1].encode())
                        c.append((best[i - 1][0] + token_counts.UNKNOWN * z, best[i - 1][1] - z))
                    best.append(max(c, key=lambda x: (round(x[0], 8), x[1])))
                n -= best[-1][1]
        return n

    texts = [t for _, t in mixed(5)] + ["日本語 😀😀", "a" * 200, "the" * 700, "thé日😀of" * 300 + " the " + "qzx" * 400]
    assert u.counts(pa.array(texts, pa.string()))[0].tolist() == [plain(t) for t in texts]
    monkeypatch.setattr(token_counts, "PART", 37)  # parts of long words join without a seam
    u.clear()
    assert u.counts(pa.array(texts, pa.string()))[0].tolist() == [plain(t) for t in texts]


def test_token_counts_of_a_very_long_word():
    import time

    u = token_counts.unigram(sentencepiece_bpe.default_model())
    u.clear()
    t = time.perf_counter()
    n = u.counts(pa.array(["abcdefghij" * 30_000]))[0][0]
    assert 300_000 / 16 < n <= 300_001 and time.perf_counter() - t < 30


def test_language_id():
    import pyarrow.parquet as pq

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    held = t.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)
    m = language_id.train(list(t[~held].text[:500]), list(t[~held].lang[:500]))
    lang, score = language_id.read(m, pa.array(t[held].text))
    assert np.mean(np.array(lang) == t[held].lang.values) > 0.97 and score.min() >= 0 and score.max() <= 1
    assert language_id.read(m, pa.array([None, "", "12 !", "—", "日本"]))[0][:4] == ["und"] * 4 and language_id.read(m, pa.array(["日本"]))[0][0] != "und"
    assert language_id.train([], []).langs == ["und"]
    # neither the neighbours nor the place in a batch have a say; what stands before and after a place does
    some = list(t[held].text[:50])
    alone = np.concatenate([language_id.read(m, pa.array([x]))[1] for x in some])
    assert np.allclose(alone, language_id.read(m, pa.array(some))[1], atol=1e-5)


def plain_network(m, text):
    """The mean probabilities of a text, one number at a time."""
    b, k, n_l = bytes(text.encode()).lower(), m.u.shape[1], len(m.langs)
    soft = lambda v: v / (1 + abs(v))

    def go(d, ids):
        h, out = [0.0] * k, []
        for c in ids:
            a = [float(v) for v in m.x[d][c]]
            hu = [sum(h[i] * float(m.u[d][i][j]) for i in range(k)) for j in range(3 * k)]
            z = [(1 + soft(a[j] + hu[j])) / 2 for j in range(k)]
            r = [(1 + soft(a[k + j] + hu[k + j])) / 2 for j in range(k)]
            c_ = [soft(a[2 * k + j] + r[j] * hu[2 * k + j]) for j in range(k)]
            h = [h[j] + z[j] * (c_[j] - h[j]) for j in range(k)]
            out.append(h)
        return out

    total = np.zeros(n_l)
    for s in range(0, len(b), language_id.STRETCH):
        e = min(len(b), s + language_id.STRETCH)
        lead, tail = max(0, s - language_id.LEAD), min(len(b), s + language_id.STRETCH + language_id.LEAD)
        f, g = go(0, b[lead:e])[s - lead :], go(1, b[s:tail][::-1])[::-1][: e - s]
        for x, y in zip(f, g):
            total += language_id._softmax(np.array(x + y) @ m.out.astype(float) + m.bias)
    return total / max(1, len(b))


def test_language_network_against_plain_python():
    m = language_id.blank_model(["a", "b", "c"], hidden=3)
    m.bias[:] = [0.1, -0.2, 0.3]
    texts = ["x", "Ab 12, é", "q" * 64, "word by word " * 5, "".join(map(chr, range(33, 127))) * 3, "end " * 41]
    data, off = language_id.column(pa.array(texts))
    got = language_id.position_sums(m, language_id.LOWER[data], off) / np.diff(off)[:, None]
    assert np.allclose(got, [plain_network(m, t) for t in texts], atol=1e-5)


def test_language_sample_has_every_language(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de") for i in range(3000)] + [(3000 + i, "rare", "fi") for i in range(3)] + [(9000, f"same {i}", "sv") for i in range(400)] + [(9001, None, "xx"), (9002, "x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    texts, langs = language_id.training_rows(d, rows=63)
    assert Counter(langs) == {"en": 20, "de": 20, "sv": 20, "fi": 3} and texts.count("rare") == 3
    assert set(language_id.training_rows(d, rows=2)[1]) == {"en", "de", "sv", "fi"}
    assert language_id.training_rows(d.limit(0)) == ([], [])


def test_language_gradients():
    m = language_id.blank_model(["a", "b"], hidden=3, kind=np.float64)
    texts, y = ["ab", "c" * 64 + "abc", "abcabd " * 11, "a b"], np.array([0, 1, 1, 0, 1, 0])
    data, off = language_id.column(pa.array(texts))
    row, start, end = language_id.lanes(off)
    at = language_id._grid(language_id.LOWER[data], start), start == off[row], end - start, y
    loss, grads = language_id.gradients(m, *at)
    rng, e = np.random.default_rng(0), 1e-5
    for p, g in zip((m.x, m.u, m.out, m.bias), grads):
        for k in [np.unravel_index(i, p.shape) for i in (rng.choice(np.flatnonzero(np.abs(g) > 1e-6), 12) if p.size > 12 else range(p.size))]:
            p[k] += e
            hi = language_id.gradients(m, *at)[0]
            p[k] -= 2 * e
            lo = language_id.gradients(m, *at)[0]
            p[k] += e
            assert abs((hi - lo) / (2 * e) - g[k]) < 1e-4 * max(1e-2, abs(g[k])), (p.shape, k)
    assert np.abs(grads[0][1]).sum() > 0 and np.abs(grads[1][1]).sum() > 0


def test_language_id_clashing_names(spark):
    m = language_id.train(["ab cd ef"] * 4, ["x", "y"] * 2)
    d = spark.createDataFrame([(1, "ab", 0.77)], "doc_id long, text string, Score double")
    with pytest.raises(ValueError):
        language_id.predict(d, m)
    assert language_id.predict(d, m, score_out="s2").first().Score == 0.77


def test_license_scan(spark):
    s = license_scan.Scanner(["Plain words about nothing.\nThe house is old."] * 20)
    assert s.held_out > 0.95
    rows = [(1, "Hello\nReleased under the MIT License.\n"), (2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), (3, "Licensed under the Zormel License."), (4, "The license plate"), (5, None), (6, ""), (7, "x\n" * 50 + "All rights reserved."), (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    r = {x.doc_id: x for x in license_scan.scan(docs(spark, rows), s).collect()}
    assert r[1].families == "MIT" and r[2].families == "Apache-2.0" and r[7].families == "All-rights-reserved" and r[8].families == "CC-BY-NC,MIT"
    assert r[3].families == "" and r[3].n_unknown == 1 and r[4].n_notices == 0 and r[5].n_paragraphs == r[6].n_paragraphs == 0 and r[7].n_paragraphs == 51


WRAPPED = {
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation; either version 2 of the License, or", "(at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction"],
    "AGPL": ["This work is", "licensed under", "the GNU Affero", "General Public", "License."],
}


def test_license_scan_of_wrapped_notices(spark):
    s = license_scan.Scanner(["Plain words about nothing.\nThe house is old."] * 20)
    rows, want = [], {}
    for k, (family, lines) in enumerate(WRAPPED.items()):
        for j, (mark, end) in enumerate([("", "\n"), (" * ", "\r\n"), ("# ", "\n")]):
            rows.append((10 * k + j, end.join(["The house is old.", *(mark + x for x in lines), mark, "Plain words."])))
            want[10 * k + j] = (len(lines) + 2 + bool(mark.strip()), 1, 0, family)
    rows += [(100, "\n".join([*WRAPPED["MIT"], "", *WRAPPED["BSD"]])), (101, "\n\n".join(WRAPPED["AGPL"])), (102, "Released under the MIT\nLicense.\nLicensed under CC\nBY-NC 4.0."), (103, "the public\nroad was released\nunder the bridge of the\nGNU and its license")]
    r = {x.doc_id: x for x in license_scan.scan(docs(spark, rows), s).collect()}
    assert {i: (r[i].n_paragraphs, r[i].n_notices, r[i].n_unknown, r[i].families) for i in want} == want
    assert r[100].families == "BSD,MIT" and r[101].families == "" and r[102].families == "CC-BY-NC,MIT" and r[102].n_notices == 2 and r[103].families == ""


def test_license_versions_and_training(spark):
    d = spark.createDataFrame([(1, "Plain words.\nMore plain words."), (1, "Plain words.\nMore plain words."), (None, "x"), (2, None), (3, ""), (4, "long line " * 9000)], "doc_id long, text string")
    s = license_scan.train(d)
    assert license_scan.train(d.limit(0)).held_out > 0.9
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License"
    rows = [(1, gpl.format(";", ";", 2)), (2, gpl.format(":", ",", 3)), (3, gpl.format(":", ",", 4)), (4, "ISC License"), (5, "Licensed under the LGPL version 2.1"), (6, "Use of this source code is governed by the Quux license that can be found in the LICENSE file."), (7, "This work is licensed under a Creative Commons Attribution 4.0 International License."), (8, "Licensed under CC BY 3.0.")]
    r = {x.doc_id: x for x in license_scan.scan(docs(spark, rows), s).collect()}
    assert [r[i].families for i in range(1, 9)] == ["GPL-2.0", "GPL-3.0", "", "ISC", "LGPL", "", "CC-BY", ""]
    assert r[3].n_unknown == r[6].n_unknown == 1 and all(0 <= r[i].score <= 1 for i in r)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b c", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é" * 9000), (6, "x", "WARC/1.1\r\n\r\n\r\n\r\n"), (7, "y", "same")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(p, str(tmp_path / "w")).collect()}
    pay = {i: (h or "").encode() for i, _, h in rows}
    top = {b: max(i for i in pay if pay[i] == b) for b in pay.values()}
    assert got == {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top[b] == i else "revisit", None if top[b] == i else top[b]) for i, b in pay.items()}
    body = warc.read(spark, f"file://{tmp_path}/w", payloads=True).where("record_type = 'response'")
    assert {r.page_id: bytes(r.payload) for r in body.collect()} == {i: b for i, b in pay.items() if top[b] == i}


def test_warc_odd_rows(spark, tmp_path):
    kind = "page_id long, url string, html string"
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "v", "same"), (None, None, None), (2, "w", "")]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, kind), str(tmp_path / "w")).collect()), key=repr)
    assert got == sorted([(1, 4, "response", None)] * 2 + [(None, 4, "response", None), (None, 0, "response", None), (2, 0, "response", None)], key=repr)
    assert warc.round_trip(spark.createDataFrame([], kind), str(tmp_path / "e")).count() == 0
    # archives of another attempt in the folder aren't read
    stray = tmp_path / "s" / "000000-99"
    stray.mkdir(parents=True)
    (stray / "pages-x-000000-00000.warc").write_bytes(warc.record(77, "u", b"x", "D"))
    assert warc.round_trip(spark.createDataFrame(rows, kind), str(tmp_path / "s")).count() == 5


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    recs = [warc.record(i, f"http://x/{i}", os.urandom(500), "D") for i in range(20)]
    if packed:
        z = [zlib.compressobj(1, zlib.DEFLATED, 31) for _ in recs]
        recs = [c.compress(r) + c.flush() for c, r in zip(z, recs)]
    at = np.cumsum([0, *map(len, recs)])
    data = bytearray(b"".join(recs))
    data[at[5] + 300 : at[5] + 320] = b"#" * 20
    data[at[9] : at[9] + 4] = b"!!!!"
    data = bytes(data[: at[19] + 40])
    seen = list(warc.salvage(data))
    ids = [int(re.search(r"\d+", x[3]["warc-record-id"])[0]) for x in seen if x[0] == "record"]
    assert ids == [i for i in range(19) if i not in (5, 9)]
    assert [(x[1], x[2]) for x in seen if x[0] == "gap"] == [(at[5], at[6]), (at[9], at[10]), (at[19], len(data))]
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"junk")] == ["gap"]


def test_warc_long_urls(spark, tmp_path):
    rows = [(1, "http://a/" + "é" * 50_000, "x"), (2, "http://b/" + " " * 40_000, "y"), (3, "http://c", "y")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(p, str(tmp_path / "w")).collect()}
    assert got == {1: (1, "response", None), 2: (1, "revisit", 3), 3: (1, "response", None)}
    long = warc.record(1, rows[0][1], b"x", "D")
    broken = long.replace(warc.END, b"\r\n", 1)  # ends nowhere before the next record
    assert [x[0] for x in warc.salvage(broken + long)] == ["gap", "record"]


def test_warc_salvage_within_a_member():
    def ids(data):
        return [int(re.search(r"\d+", x[3]["warc-record-id"])[0]) for x in warc.salvage(data) if x[0] == "record"]

    def gaps(data):
        return [(x[1], x[2]) for x in warc.salvage(data) if x[0] == "gap"]

    def pack(data):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    recs = [warc.record(i, f"http://x/{i}", os.urandom(5000), "D") for i in range(10)]
    spoilt = recs[4][:2000] + b"#" * 20 + recs[4][2020:]
    one = pack(b"".join([*recs[:4], spoilt, *recs[5:]]))
    last = pack(warc.record(77, "http://x", b"z", "D"))
    assert ids(one + last) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 77] and gaps(one + last) == [(0, len(one))]
    whole = pack(b"".join(recs))
    short = whole[: len(whole) * 3 // 4]
    assert ids(short) == list(range(7)) and gaps(short) == [(0, len(short))]
    wrong_sum = whole[:-8] + b"####" + whole[-4:]
    assert ids(wrong_sum + last) == [*range(10), 77] and gaps(wrong_sum + last) == [(0, len(whole))]
    bare = re.sub(rb"WARC-Block-Digest[^\r]*\r\n", b"", recs[0])
    unsure = pack(bare)[:-8] + b"####" + pack(bare)[-4:]
    assert ids(pack(bare)) == [0] and ids(unsure + last) == [77]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    c = rng.standard_normal((6, 16))
    v = [(c[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.12, 1.0])).astype(np.float32).tolist() for i in range(300)]
    rows = [(i, x, int(i % 2)) for i, x in enumerate(v)] + [(400 + i, v[0], 0) for i in range(4)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, v[0], None), (503, [float("nan")] * 16, 0), (504, [], 1), (505, v[0][:3], 0), (506, [None] * 16, 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.array(x, float), lab) for i, x, lab in rows if lab is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    links = [(a, b) for (a, x, p), (b, y, q) in itertools.combinations(ok, 2) if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    n, comp = Counter(i for p in links for i in p), smallest([r[0] for r in rows], links)
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_duplicates(e).collect()}
    assert got == {r[0]: (n[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows} and len(links) > 100
    assert embedding_dedup.near_duplicates(e.limit(0)).count() == 0


def test_embeddings_in_split_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CAP", 20)
    monkeypatch.setattr(embedding_dedup, "GROUP", 5)
    test_embeddings_against_all_pairs(spark)


def test_multi_sequence_traversal():
    rng = np.random.default_rng(4)
    a, b = rng.random((30, 7)) ** 2, rng.random((30, 5)) ** 2
    q, i, j = embedding_dedup.traverse(a, b, 0.6)
    for r in range(30):
        got = [(x, y) for k, x, y in zip(q.tolist(), i.tolist(), j.tolist()) if k == r]
        assert set(got) == {(x, y) for x in range(7) for y in range(5) if a[r, x] + b[r, y] <= 0.6} and len(got) == len(set(got))
        order = [a[r, x] + b[r, y] for x, y in got]
        assert order == sorted(order)
    assert len(embedding_dedup.traverse(a[:0], b[:0], 0.6)[0]) == 0


def test_sharding(spark):
    rows = mixed(11) + [(5000 + i, "hot text") for i in range(200)]
    d = docs(spark, rows)
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    for law in ("bytes", "rows", "key"):
        r = sharding.shard(d, 4, law).collect()
        assert len(r) == len(rows) and all(x["size"] == size[x.doc_id] and x.text_crc32 == zlib.crc32((dict(rows)[x.doc_id] or "").encode()) for x in r)
        for s in range(4):
            assert sorted(x.slot for x in r if x["shard"] == s) == list(range(sum(x["shard"] == s for x in r)))
        n = Counter(x["shard"] for x in r)
        if law == "rows":
            assert max(n.values()) - min(n.values()) <= 1
        if law == "key":
            assert {x.grown_shard for x in r if x.grown_shard != x["shard"]} == {4}
    assert sharding.shard(d.limit(0), 4).count() == 0
    b = np.bincount(sharding.pack(np.array([[s, s // 5, 1] for s in size.values()]), 4), list(size.values()))
    assert b.max() <= 1.1 * max(b.mean(), max(size.values()))  # rows count too, so a text larger than a shard is not alone


def test_shards_of_equal_bytes(spark):
    rng = random.Random(8)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([3, 30, 300]))) for _ in range(1500)] + ["copy of one text " * 20] * 400 + ["twice"] * 2 + [None, "", None]
    rows = list(enumerate(texts)) + [(None, "no id"), (None, "no id either"), (7, "another text of seven")]
    r = sharding.shard(docs(spark, rows), 4).collect()
    assert len(r) == len(rows)
    at = [[x for x in r if x["shard"] == s] for s in range(4)]
    assert all(sorted(x.slot for x in p) == list(range(len(p))) for p in at)
    for n in ([sum(x.size for x in p) for p in at], [len(p) for p in at]):
        assert max(n) <= 1.05 * sum(n) / 4, n
    of = {}
    for x in r:
        of.setdefault(x.text_crc32, set()).add(x["shard"])
    hot = zlib.crc32(texts[1600].encode())
    assert len(of.pop(hot)) > 1  # over half a shard
    assert max(map(len, of.values())) <= 2 and sum(len(s) > 1 for s in of.values()) <= 1  # null and empty are two groups with one sum


def test_odd_rows_everywhere(spark):
    """Repeated rows, null ids, empty tables."""
    rows = spark.createDataFrame([(1, "a b c d e f " * 20), (1, "a b c d e f " * 20), (None, "a b c d e f " * 20), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f " * 3)], "item_id long, text string")
    scan = license_scan.Scanner(["words"])
    model = language_id.train(["ab cd ef"] * 4, ["x", "y"] * 2)
    ops = [
        lambda d: sharding.shard(d, 3), lambda d: jaccard_join.link_documents(d), suffix_dedup.digests, lambda d: language_id.predict(d, model), sentencepiece_bpe.round_trip, lambda d: license_scan.scan(d, scan), token_counts.count_tokens, lambda d: decontamination.score(d, bench),
        lambda d: decontamination.remove_spans(d, bench),
    ]
    for i, op in enumerate(ops):
        out = op(rows).collect()
        assert len(out) == 4, i
        assert op(rows.limit(0)).count() == 0, i


def test_queries_are_named_by_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_pipeline_stages(spark):
    import corpus_pipeline

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    from pulseframe.llm.shared import cut

    d = spark.read.parquet(f"{SF}/documents.parquet")
    cols, kept = d.columns, [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = cut(stage(spark, d, SF), name)
        kept.append(d.count())
        if name != "sentencepiece":
            assert d.columns == cols, name
        if name == "jaccard_join":
            s = {r.doc_id: sets_of(r.text, 5) for r in before.collect()}
            comp = smallest(s, [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])
            assert {r.doc_id for r in d.collect()} == {i for i in comp if comp[i] == i}
        if name == "decontamination":
            sc = decontamination.score(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert d.count() == sc.where(~F.col("contaminated")).count()
    assert kept[0] > kept[-1] > 0.8 * kept[0]
