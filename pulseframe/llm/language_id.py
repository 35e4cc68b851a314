"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (A-Z lower-cased, everything else as it is) in both directions and gives every
position, spaces and digits too, a distribution over the languages; a document's probabilities are the mean over all
its positions. Texts are read in stretches of STRETCH bytes side by side, each direction after LEAD bytes of what lies
before it, so its state comes from across words and from beyond the stretch's edge. Gates use x / (1 + |x|) in place of
the exponential. Training is backpropagation through time in numpy on the driver, on a bounded sample of labelled rows
(SAMPLE_ROWS documents shared equally by the languages, PIECES pieces of PIECE characters from all over each of their
texts); prediction reads every byte of every text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches
from .textnp import LOWER, column, owner, slabs, tidy, within

SAMPLE_ROWS = 1200
PIECES, PIECE = 12, 96
HIDDEN = 8
STEPS = 300
BATCH = 192
STRETCH, LEAD = 64, 16
LANES = 4096  # stretches read side by side
SLAB = 1 << 20
UNKNOWN = "und"

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


@dataclass
class Model:
    langs: list[str]
    x: np.ndarray  # (2, 256, 3H): what a byte adds to the update, reset and candidate gates
    u: np.ndarray  # (2, H, 3H)
    out: np.ndarray  # (2H, L)
    bias: np.ndarray


def _soft(v: np.ndarray) -> np.ndarray:
    """v / (1 + |v|), in place."""
    v /= np.abs(v) + 1
    return v


def _step(x, u, ids, h):
    """The next state of every lane, and what backpropagation needs."""
    k = u.shape[0]
    a, hu = np.take(x, ids, axis=0), h @ u
    g = a[:, : 2 * k] + hu[:, : 2 * k]
    _soft(g)
    z, r = g[:, :k], g[:, k:]
    g += 1
    g *= 0.5
    c = r * hu[:, 2 * k :]
    c += a[:, 2 * k :]
    _soft(c)
    return h + z * (c - h), (h, hu, z, r, c)


def lanes(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end of the row) of each stretch of texts with these offsets."""
    n = -(-np.diff(off) // STRETCH)
    row = np.repeat(np.arange(len(n)), n)
    return row, off[row] + STRETCH * within(n)[1], off[row + 1]


def _grid(low: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(LEAD + STRETCH + LEAD, lanes) bytes around the stretches; beyond the data anything."""
    at = start + np.arange(-LEAD, STRETCH + LEAD)[:, None]
    return low[np.clip(at, 0, len(low) - 1)]


def _forward(m: Model, ids, first, room):
    """States of both directions at the STRETCH positions, and what backpropagation needs, from the first step on.

    first: lanes at the beginning of their text; room: bytes of the text from the lane's first position on.
    """
    n, k = ids.shape[1], m.u.shape[1]
    fs, kf, kb = [], [], []
    h = np.zeros((n, k), m.x.dtype)
    for i in range(LEAD + STRETCH):
        if i == LEAD:
            h = np.where(first[:, None], 0, h).astype(m.x.dtype)
        h, kept = _step(m.x[0], m.u[0], ids[i], h)
        kf.append(kept)
        if i >= LEAD:
            fs.append(h)
    bs = [None] * STRETCH
    h = np.zeros((n, k), m.x.dtype)
    for i in range(STRETCH + LEAD - 1, -1, -1):
        ends = room == i + 1
        if ends.any():
            h = np.where(ends[:, None], 0, h).astype(m.x.dtype)
        h, kept = _step(m.x[1], m.u[1], ids[LEAD + i], h)
        kb.append(kept)
        if i < STRETCH:
            bs[i] = h
    return fs, bs, kf, kb


def _back(u, ids, kept, dh_all, cut, gx, gu):
    """Gradients of one direction. Steps in the order in which they were made; cut[i]: lanes that began anew before step i."""
    k = u.shape[0]
    dh = np.zeros_like(kept[0][0])
    for i in range(len(kept) - 1, -1, -1):
        h, hu, z, r, c = kept[i]
        if dh_all[i] is not None:
            dh = dh + dh_all[i]
        dc = dh * z * (1 - np.abs(c)) ** 2
        # z = (1 + s) / 2 with s = v / (1 + |v|)
        dz = dh * (c - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dc * hu[:, 2 * k :] * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        dhu = np.concatenate([dz, dr, dc * r], 1)
        gu += h.T @ dhu
        np.add.at(gx, ids[i], np.concatenate([dz, dr, dc], 1))
        dh = dh * (1 - z) + dhu @ u.T
        if cut[i] is not None:
            dh = np.where(cut[i][:, None], 0, dh)


def _softmax(v):
    v = np.exp(v - v.max(-1, keepdims=True))
    return v / v.sum(-1, keepdims=True)


def gradients(m: Model, ids, first, room, y):
    """Mean loss over all positions, and its gradients in the order of the model's arrays."""
    fs, bs, kf, kb = _forward(m, ids, first, room)
    st = np.stack([np.concatenate([f, b], 1) for f, b in zip(fs, bs)])
    mask = (np.arange(STRETCH)[:, None] < room).astype(st.dtype)
    w = (mask / mask.sum())[:, :, None]
    p = _softmax(st @ m.out + m.bias)
    loss = -(np.log(p[:, np.arange(len(y)), y] + 1e-12) * w[:, :, 0]).sum()
    d = p
    d[:, np.arange(len(y)), y] -= 1
    d *= w
    ds, k = d @ m.out.T, m.u.shape[1]
    gx, gu = np.zeros_like(m.x), np.zeros_like(m.u)
    _back(m.u[0], ids, kf, [None] * LEAD + list(ds[:, :, :k]), [first if i == LEAD else None for i in range(LEAD + STRETCH)], gx[0], gu[0])
    order = range(STRETCH + LEAD - 1, -1, -1)
    cuts = [e if (e := room == i + 1).any() else None for i in order]
    _back(m.u[1], ids[LEAD:][::-1], kb, [ds[i, :, k:] if i < STRETCH else None for i in order], cuts, gx[1], gu[1])
    return loss, [gx, gu, np.einsum("tnk,tnl->kl", st, d), d.sum((0, 1))]


def blank_model(langs: list[str], hidden: int = HIDDEN, seed: int = 5, kind=np.float32) -> Model:
    rng = np.random.default_rng(seed)
    k, n_l = hidden, max(1, len(langs))
    return Model(langs or [UNKNOWN], (rng.standard_normal((2, 256, 3 * k)) * 0.5).astype(kind), (rng.standard_normal((2, k, 3 * k)) * 0.5).astype(kind), (rng.standard_normal((2 * k, n_l)) * 0.5).astype(kind), np.zeros(n_l, kind))


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """Fit on labelled texts, all languages with equal weight; no text or one language gives a model that knows what it was given."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    m = blank_model(langs, seed=seed)
    if len(langs) < 2:
        return m
    data, off = column(pa.array(texts, pa.string()))
    low, (row, start, end) = LOWER[data], lanes(off)
    if not len(start):
        return m
    y = np.array([langs.index(x) for x in labels])[row]
    pick = (1 / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y]
    pick /= pick.sum()
    params = [m.x, m.u, m.out, m.bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = rng.choice(len(y), STEPS * BATCH, p=pick)
    for step in range(STEPS):
        r = order[step * BATCH : (step + 1) * BATCH]
        _, grads = gradients(m, _grid(low, start[r]), start[r] == off[row[r]], end[r] - start[r], y[r])
        rate = 0.02 * min(1, 2 * (1 - step / STEPS)) + 1e-4
        for p_, g, a, b in zip(params, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p_ -= (rate * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(b / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(p_.dtype)
    return m


class _Runner:
    """Steps of one direction for reading, a row for each unit and a column for each lane, in arrays that are used again."""

    def __init__(self, x: np.ndarray, u: np.ndarray, n: int):
        k = u.shape[0]
        self.k, self.x, self.u = k, np.ascontiguousarray(x.T), np.ascontiguousarray(u.T)
        self.h, self.c = np.zeros((k, n), np.float32), np.empty((k, n), np.float32)
        self.a, self.hu = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
        self.g, self.d = np.empty((2 * k, n), np.float32), np.empty((2 * k, n), np.float32)

    def step(self, ids: np.ndarray) -> np.ndarray:
        k, a, hu, g, c, d = self.k, self.a, self.hu, self.g, self.c, self.d
        np.take(self.x, ids.astype(np.intp), axis=1, out=a, mode="clip")
        np.matmul(self.u, self.h, out=hu)
        np.add(a[: 2 * k], hu[: 2 * k], out=g)
        np.abs(g, out=d)
        d += 1
        g /= d
        g += 1
        g *= 0.5
        np.multiply(g[k:], hu[2 * k :], out=c)
        c += a[2 * k :]
        np.abs(c, out=d[:k])
        d[:k] += 1
        c /= d[:k]
        c -= self.h
        c *= g[:k]
        self.h += c
        return self.h


def position_sums(m: Model, low: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text the sum over all its positions of the positions' probabilities: (rows, L)."""
    row, start, end = lanes(off)
    total = np.zeros((len(off) - 1, len(m.langs)))
    k = m.u.shape[1]
    wf, wb = np.ascontiguousarray(m.out[:k].T), np.ascontiguousarray(m.out[k:].T)
    top = max(0.0, float((np.abs(m.out).sum(0) + np.abs(m.bias)).max()) - 60)  # states are in (-1, 1), so no exponent is larger than 60
    for at in range(0, len(start), LANES):
        r = slice(at, at + LANES)
        ids, room, first = _grid(low, start[r]), end[r] - start[r], start[r] == off[row[r]]
        n = ids.shape[1]
        logits = np.empty((STRETCH, len(m.langs), n), np.float32)
        f = _Runner(m.x[0], m.u[0], n)
        for i in range(LEAD + STRETCH):
            if i == LEAD:
                f.h[:, first] = 0
            h = f.step(ids[i])
            if i >= LEAD:
                np.matmul(wf, h, out=logits[i - LEAD])
        logits += m.bias[:, None]
        short = np.flatnonzero(room < STRETCH + LEAD)
        tail = short[room[short] < STRETCH]
        ends = {e: short[room[short] == e] for e in np.unique(room[short]).tolist()}
        b = _Runner(m.x[1], m.u[1], n)
        got = np.zeros((len(m.langs), n), np.float32)
        for i in range(STRETCH + LEAD - 1, -1, -1):
            if i + 1 in ends:
                b.h[:, ends[i + 1]] = 0
            h = b.step(ids[LEAD + i])
            if i < STRETCH:
                p = wb @ h
                p += logits[i]
                p -= top
                np.exp(p, out=p)
                p /= p.sum(0)
                p[:, tail[room[tail] <= i]] = 0
                got += p
        for j in range(len(m.langs)):
            total[:, j] += np.bincount(row[r], got[j], minlength=len(total))
    return total


def read(m: Model, a: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text and its mean probability."""
    langs, scores = [], []
    off = column(a)[1]
    for i, j in slabs(off, SLAB):
        part = a.slice(i, j - i)
        data, o = column(part)
        n = j - i
        prob = position_sums(m, LOWER[data], o) / np.maximum(np.diff(o), 1)[:, None] if len(data) else np.zeros((n, len(m.langs)))
        lettered = np.zeros(n, bool)
        lettered[owner(o, np.flatnonzero(ASCII_LETTER[data]))] = True
        for r in np.flatnonzero(~lettered).tolist():
            t = part[r].as_py()
            lettered[r] = bool(t) and any(map(str.isalpha, t))
        best = prob.argmax(1)
        langs += [m.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
        scores.append(np.where(lettered, np.clip(prob[np.arange(n), best], 0, 1), 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def training_rows(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """Pieces of a sample of labelled rows: of each language the first by a hash of the key, equally many as far as it has them.

    At most `rows` rows in all, but one of each language at least; PIECES pieces from all over each text (a text that is
    shorter than they would be comes whole).
    """
    r = F.xxhash64(F.col(key).cast("string"))
    some = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(r.alias("r"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {g.l: g["n"] for g in some.groupBy("l").agg(F.count("*").alias("n")).collect()}
    # what languages with few rows leave is shared by the others
    left, each = rows, {}
    for k, x in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        each[x] = max(1, min(sizes[x], left // (len(sizes) - k)))
        left -= each[x]
    n = F.length("t")
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring("t", (F.lit(1) + F.floor(k * (n - PIECE) / (PIECES - 1))).cast("int"), F.lit(PIECE)))
    pieces = F.when(n <= PIECES * PIECE, F.array("t")).otherwise(spread)

    def first(part: DataFrame, langs) -> list:
        top = part.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("r", F.md5("t")))).where(F.col("k") <= max(each.values()))
        top = top.select("r", "l", "k", pieces.alias("p"))
        return [g for g in top.collect() if g.l in langs and g["k"] <= each[g.l]]

    if not sizes:
        return [], []
    # a little more than needed, so that no sort of all rows is made; the row numbers are exact
    bars = df.sparkSession.createDataFrame([(x, int((1 << 30) * min(1.0, (2.0 * each[x] + 20) / n_))) for x, n_ in sizes.items()], "l string, bar long")
    got = first(some.join(F.broadcast(bars), "l").where(F.pmod("r", F.lit(1 << 30)) < F.col("bar")), sizes)
    # where many rows share a key, its hash can leave out too many
    have = Counter(g.l for g in got)
    short = [x for x in sizes if have[x] < each[x]]
    if short:
        got = [g for g in got if g.l not in set(short)] + first(some.where(F.col("l").isin(short)), set(short))
    got.sort(key=lambda g: (g.r, g.p, g.l))
    return [p for g in got for p in g.p], [g.l for g in got for _ in g.p]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    return train(*training_rows(df, text, lang, key))


def predict(df: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns, the language of each whole text and its mean probability, 0 to 1.

    A null text, or one without letters, is `und` with score 0. Repeated rows stay, an empty table gives no rows. It is
    an error if df has a column of an output's name.
    """
    taken = {c.lower() for c in df.columns} & {lang_out.lower(), score_out.lower()}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already: name the outputs otherwise")
    small_batches(df.sparkSession)
    names = df.columns

    @tidy
    def run(batches):
        for b in batches:
            langs, scores = read(model, b.column(names.index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_out, score_out])

    return df.mapInArrow(run, df.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema)


def held_out(key: str = "doc_id"):
    """Rows that training leaves out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on labelled rows that aren't held out; key, held_out, lang_pred and score of every row.

    A null key counts as not held out; without labelled rows every text with letters is `und` too. Repeated rows stay.
    """
    model = fit(df.where(~F.coalesce(held_out(key), F.lit(False))).select(key, text, lang), text, lang, key)
    return predict(df.select(F.col(key).alias("k"), F.col(text).alias("t")), model, "t").select(F.col("k").alias(key), F.coalesce(held_out("k"), F.lit(False)).alias("held_out"), "lang_pred", "score")
