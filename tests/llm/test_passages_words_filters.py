"""Window dedup, spelling variants and the filter audit against plain programs, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pulseframe.llm import filter_audit, queries, spelling, window_dedup

DOCS = "doc_id long, text string, source string, n int, h string, word string, anchor string, part string, id int"  # with names used inside
GAP = r"[^\x20\x09-\x0D]+"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, 1, "x", "y", "z", "p", 5) for i, t, s in rows], DOCS).repartition(parts)


def passages(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k, gap=" ": gap.join(rng.choice(words) for _ in range(k))
    p = [text(n) for n in (34, 35, 36, 52, 90)]
    out = [None, "", " \n", "x " * 34, "y " * 35, "y " * 36, "z " * 200, "a b " * 60, text(5), text(400) + " " + text(12000)]
    out += [text(rng.randint(0, 60)) + "\t" + x + " \n" + text(rng.randint(0, 40)) for x in p for _ in range(3)]
    out += [p[4].upper(), p[3].replace(" ", "\n \t"), p[4] + " " + text(20) + " " + p[4]]
    a = p[4].split()
    out += [" ".join(a[:50]), " ".join(a[20:70]), " ".join(a[10:45]), " ".join(a[:34])]
    whole = text(120)
    out += [whole, whole, whole + " end"]
    rows = [(k, t, "s") for k, t in enumerate(out, 7)]
    return rows + [(8, "w", "s"), (None, whole, "s"), (None, None, "s"), rows[-6], rows[-6]]


def cut_windows(rows, width):
    split = [re.findall(GAP, t or "") for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (d, _, _), w in zip(rows, split):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), " ".join(kept)))
    return out


@pytest.mark.parametrize("width", [35, 5])
def test_windows_against_brute_force(spark, width):
    rows = passages()
    want = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in cut_windows(rows, width)), key=repr)
    got = window_dedup.digests(docs(spark, rows), width)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and sum(x[2] > 0 for x in want) > 10
    kept = window_dedup.remove_repeats(docs(spark, rows), width)
    assert kept.columns == docs(spark, []).columns
    plain = {t: k for (_, t, _), (_, _, g, k) in zip(rows, cut_windows(rows, width)) if g}
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr((d, plain.get(t, t))) for d, t, _ in rows)


def test_windows_do_not_depend_on_the_sketch(spark, monkeypatch):
    """A sketch that is full lets everything through, and the result stays."""
    rows = passages(9)
    want = sorted((tuple(r) for r in window_dedup.digests(docs(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(window_dedup, "prefilter", lambda *a: (16, b"\xff" * (3 << 13)))
    assert sorted((tuple(r) for r in window_dedup.digests(docs(spark, rows, 1)).collect()), key=repr) == want


def test_the_sketch_never_underestimates(spark):
    rows = passages(3)
    bits, table = window_dedup.prefilter(spark, docs(spark, rows).select("text"), 35)
    h = np.concatenate([window_dedup.Words(pa.array([t], pa.string())).anchors(35)[0] for _, t, _ in rows])
    values, n = np.unique(h, return_counts=True)
    twice = np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool)
    passed = np.logical_and.reduce([twice[window_dedup._cells(values, r, bits) + (r << bits)] for r in range(3)])
    assert passed[n > 1].all() and (n > 1).sum() > 20 and passed[n == 1].sum() < 0.05 * (n == 1).sum()


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    n = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, n[w], len(others)]
    rows = set()
    for w, (form, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, k, m, n[form] if form else None))
    return rows


def test_spelling_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.randint(6, 11))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    words = []
    for w in base:
        words += [w] * 300
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdez") + w[i:], w[:i] + rng.choice("abcdez") + w[i + 1 :]])
            words += [v] * rng.choice([2, 3, 20, 30])
            j = rng.randrange(len(v))
            words += [v[:j] + rng.choice("xyz") + v[j + 1 :]] * rng.choice([2, 2, 3])
    rng.shuffle(words)
    rows = [(i, " ".join(words[k : k + 60]), "s") for i, k in enumerate(range(0, len(words), 60))]
    rows += [(None, "Ünbounded ünbounded ÜNBOUNDED aaaaaaa1aaaaaaa", "s"), (3, None, "s"), (3, "", "s"), (5, "wordone", "s"), (5, "wordone", "s"), (9, "l" * 20_000 + " " + "m" * 20_000, "s"), (9, "l" * 20_000, "s")]
    got = spelling.variants(docs(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = spelled(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[1] != r[2] for r in want) and sum(r[4] for r in want) > 300


def audited(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    lowest = {}
    for d, t, _ in rows:
        if d is not None:
            lowest[t or ""] = min(d, lowest.get(t or "", d))
    bad = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(GAP, t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": d is not None and d > lowest[t]}
        bad.append((s or "", {k for k, v in f.items() if v}, d in good and d is not None, d in toxic and d is not None))
    out = set()
    for part in {b[0] for b in bad}:
        here = [b for b in bad if b[0] == part]
        shap = Counter()
        lines = []
        for o in itertools.permutations("ABCDE"):
            left = here
            for i, f in enumerate(o):
                gone = [b for b in left if f in b[1]]
                left = [b for b in left if f not in b[1]]
                shap[f] += len(gone)
                lines.append((f, part, "".join(o), i + 1, len(left), len(gone), sum(f in b[1] for b in here) - len(gone), sum(b[1] == {f} for b in here), sum(b[2] for b in gone), sum(b[3] for b in gone)))
        out |= {x[1:] + (shap[x[0]],) for x in lines}
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        w = [rng.choice("abcdefgh") * rng.randint(1, 30) for _ in range(rng.choice([10, 199, 200, 300]))]
        rows.append((i, " ".join(w) + rng.choice(["", " #", "ABCDEFGHI" * 40, ""]), rng.choice(["a", "b", None, "", "c"])))
    rows += [(200 + i, rows[i][1], "a") for i in range(30)] + [rows[3], rows[3], (3, rows[3][1], "zz"), (None, rows[4][1], "a"), (None, None, None), (500, None, "q"), (501, "", "q"), (502, " ", "q"), (-1, "x " * 40_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 230, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(filter_audit.profiles(docs(spark, rows), lab), "ABCDE").collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, labels)


def test_audit_of_other_filters(spark):
    """Shapley values of three filters add up to all that is removed, in each order."""
    rows = [(p, a, b, c, n) for p, n in (("x", 3), ("y", 1)) for a, b, c in itertools.product([False, True], repeat=3)]
    found = spark.createDataFrame(rows, "part string, P boolean, Q boolean, R boolean, docs long").selectExpr("*", "0L as good", "docs as toxic")
    got = filter_audit.audit(found, "PQR").collect()
    total = defaultdict(int)
    for r in got:
        if r.filter_order == "PQR":
            total[r.part] += r.shapley
    assert len(got) == 2 * 6 * 3 and total == {"x": 6 * 7 * 3, "y": 6 * 7} and all(r.toxic_lost == r.removed for r in got)
    with pytest.raises(ValueError):
        filter_audit.audit(found, "")


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert window_dedup.digests(none).count() == 0 and window_dedup.remove_repeats(none).count() == 0
    assert spelling.variants(none).count() == 0 and filter_audit.audit(filter_audit.profiles(none, labels), "ABCDE").count() == 0


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_filter_audit", "op13_window_dedup"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, sf)
    res = c.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(x) for x in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())
