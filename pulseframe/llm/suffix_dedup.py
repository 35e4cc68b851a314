"""Removal of byte strings that already occur in an earlier document, by distributed prefix doubling.

The corpus is stored once as units of a few MB. Positions of a text are ranked by the string of h bytes that begins
there: the rank of 2h bytes is the pair of the ranks at offsets 0 and h. Ranks are 64-bit names made of that pair, so
equal strings have equal ranks in all tasks and no renumbering is needed between rounds. Each round (h = 20, 40, ...,
below `least`)

* takes, of every window of `least` bytes that is still open, the position with the smallest rank (equal windows keep
  equal positions), so only a fraction of the positions goes through the shuffle;
* Spark deals the ranks by range of hash to tasks, which sort them and mark those that occur more than once;
* ranks that are unique leave with their windows: the texts are narrowed to the open stretches for the next offset.

What is left is past the last offset below the threshold. Runs of windows with one position are then compared as
(rank, name of the run's whole span): a run whose span occurs in a smaller document is decided; of the others the
first document of each span goes on to the last rank, that of the windows themselves, whose bytes are compared.
Copies within a unit are decided there, so that what many documents hold reaches a task once for each unit. Names
short of a whole match only choose what is compared; a decided span agrees in 96 bits, a window in its bytes.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_cut, parts_for, release, small_batches
from .textnp import BYTE_CODE, _BASE, column, mix, owner, powers, runs, slabs, tidy, within

K = 20  # the first rank's bytes
UNIT = 2 << 20  # bytes of text of a unit; a longer text has a unit of its own
SLAB = 1 << 20  # bytes ranked at a time; a longer text is ranked in overlapping parts
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_unpower = np.ones(1, np.uint64)


def _unpowers(n: int) -> np.ndarray:
    global _unpower
    if len(_unpower) < n:
        p = np.full(n, _UNBASE, np.uint64)
        p[0] = 1
        _unpower = np.cumprod(p, dtype=np.uint64)
    return _unpower


def _double(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def names(data: np.ndarray, k: int) -> np.ndarray:
    """The names of all k-byte strings of the data, by doubling."""
    a, h = BYTE_CODE[data], 1
    while 2 * h <= k:
        a = _double(a[: len(a) - h], a[h:])
        h *= 2
    return _double(a[: len(a) - (k - h)], a[k - h :]) if h < k else a


def _smallest(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    s = 1
    while 2 * s <= w:
        a = np.minimum(a[:-s], a[s:])
        s *= 2
    return np.minimum(a[: -(w - s)], a[w - s :]) if s < w else a


def _prefix(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[data] * powers(len(data) + 1)[: len(data)], dtype=np.uint64)])


def _span_names(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((p[e] - p[s]) * _unpowers(len(p))[s] + (e - s).astype(np.uint64))


def _empty():
    z = np.zeros(0, np.int64)
    return z.view(np.uint64), z, z, z


def anchors(data: np.ndarray, off: np.ndarray, least: int, k: int):
    """(rank, first window, end of windows, row) of each run of windows that share their smallest k-byte rank."""
    if len(data) < least:
        return _empty()
    m = _smallest(names(data, k), least - k + 1)
    n, size = len(m), np.diff(off)
    step = np.zeros(len(data) + 1, np.int32)
    full = size >= least
    np.add.at(step, off[:-1][full], 1)
    np.add.at(step, off[1:][full] - least + 1, -1)
    valid = np.cumsum(step)[:n] > 0
    new = np.ones(n + 1, bool)
    new[1:n] = (m[1:] != m[:-1]) | ~valid[:-1] | ~valid[1:]
    new[off[off < n]] = True
    at = np.flatnonzero(new)
    s, e = at[:-1], at[1:]
    ok = valid[s]
    s, e = s[ok], e[ok]
    return m[s], s, e, owner(off, s)


def _parts(off: np.ndarray, least: int):
    """(first row, byte from, byte to, offsets) of what is ranked at a time; parts of a long row overlap by least - 1 bytes."""
    for i, j in slabs(off, SLAB):
        a, b = int(off[i]), int(off[j])
        if j - i > 1 or b - a <= SLAB + least:
            yield i, a, b, off[i : j + 1] - a
        else:
            for p in range(a, b - least + 1, SLAB):
                q = min(b, p + SLAB + least - 1)
                yield i, p, q, np.array([0, q - p])


class Stretches:
    """A unit's open stretches: bytes, offsets, and of each the row, its first byte's place in the text, the document."""

    def __init__(self, blob, least: int):
        t = pa.ipc.open_stream(pa.py_buffer(blob)).read_all()
        if "row" not in t.column_names:  # a unit as it was stored: every text with an id is one stretch
            t = t.select(["id", "text"]).append_column("row", pa.array(np.arange(t.num_rows))).filter(t["id"].is_valid())
            t = t.append_column("start", pa.array(np.zeros(t.num_rows, np.int64)))
        self.data, self.off = column(t["text"])
        self.row, self.start, self.doc = (t[c].to_numpy().astype(np.int64) for c in ("row", "start", "id"))
        self.least = least

    def anchors(self, k: int):
        """anchors() of all stretches: (rank, first window, end of windows, stretch), in places of self.data."""
        got = [_empty()]
        for i, a, b, o in _parts(self.off, self.least):
            m, s, e, r = anchors(self.data[a:b], o, self.least, k)
            got.append((m, a + s, a + e, i + r))
        return tuple(map(np.concatenate, zip(*got)))


def _zip(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _store(text: str):
    """Rows -> (unit, blob): units of about UNIT bytes, all columns."""

    @tidy
    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def unit():
            return pa.RecordBatch.from_arrays([pa.array([part + seq], pa.int64()), pa.array([_zip(pa.Table.from_batches(held).combine_chunks())], pa.binary())], ["unit", "blob"])

        for b in batches:
            off = column(b[text])[1]
            for i, j in slabs(off, UNIT):
                held.append(b.slice(i, j - i))
                size += int(off[j] - off[i])
                if size >= UNIT:
                    yield unit()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield unit()

    return run


def _dealt(m: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of each rank. An equal pair of different ranks only keeps windows open."""
    return (m >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | m & np.uint64(0xFFFFFFFF)


def _emit(least, k, buckets):
    """A unit's ranks as sorted lists by bucket; those of several documents in the unit stand there twice."""

    @tidy
    def run(batches):
        for b in batches:
            for unit, blob in zip(b["unit"].to_pylist(), b["blob"]):
                u = Stretches(blob.as_buffer(), least)
                m, _, _, r = u.anchors(k)
                c = _ranks_of(m, u.doc[r], buckets)
                if not len(c):
                    continue
                at = (c >> np.uint64(32)).astype(np.int64)
                head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                low = c.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(at[head]), pa.array(np.full(len(head), unit)), pa.array([low[i:j].tobytes() for i, j in zip(head, [*head[1:], len(c)])], pa.binary())], ["bucket", "unit", "list"])

    return run


def _ranks_of(m: np.ndarray, doc: np.ndarray, buckets: int) -> np.ndarray:
    c = _dealt(m, buckets)
    o = np.argsort(c, kind="stable")
    c, doc = c[o], doc[o]
    head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    if not len(head):
        return c
    many = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
    return np.repeat(c[head], 1 + many)


@tidy
def _rerank(batches):
    """A partition's lists, sorted together -> of each list, which ranks occur more than once (bits), if any do."""
    bucket, unit, lists = [], [], []
    for b in batches:
        bucket.append(b["bucket"].to_numpy())
        unit.append(b["unit"].to_numpy())
        lists += b["list"].to_pylist()
    if not lists:
        return
    bucket, unit = np.concatenate(bucket), np.concatenate(unit)
    lens = np.array([len(z) // 4 for z in lists])
    c = np.repeat(bucket.astype(np.uint64) << np.uint64(32), lens) | np.frombuffer(b"".join(lists), np.uint32)
    lists.clear()
    s = np.sort(c)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return
    again = again[np.concatenate([[True], again[1:] != again[:-1]])]
    hit = again[np.minimum(np.searchsorted(again, c), len(again) - 1)] == c
    first = np.cumsum(lens) - lens
    some = np.flatnonzero(np.logical_or.reduceat(hit, first))
    for i in range(0, len(some), 4096):
        q = some[i : i + 4096]
        bits = [np.packbits(hit[x:y]).tobytes() for x, y in zip(first[q].tolist(), (first + lens)[q].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(unit[q]), pa.array(bucket[q]), pa.array(bits, pa.binary())], ["unit", "bucket", "bits"])


def _narrow(least, k, buckets):
    """Units and their marks -> units of the stretches whose windows' ranks occur more than once."""

    @tidy
    def run(batches):
        for b in batches:
            for unit, blob, marks in zip(b["unit"].to_pylist(), b["blob"], b["marks"].to_pylist()):
                u = Stretches(blob.as_buffer(), least)
                m, s, e, r = u.anchors(k)
                c = _ranks_of(m, u.doc[r], buckets)
                at = (c >> np.uint64(32)).astype(np.int64)
                hit = np.zeros(len(c), bool)
                for x in marks:
                    i, j = np.searchsorted(at, [x["bucket"], x["bucket"] + 1])
                    hit[i:j] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=j - i)
                open_ = c[hit]
                if not len(open_):
                    continue
                mine = _dealt(m, buckets)
                keep = open_[np.minimum(np.searchsorted(open_, mine), len(open_) - 1)] == mine
                s, e, r = s[keep], e[keep], r[keep]
                # runs that touch are one stretch
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != e[:-1])])
                x = np.flatnonzero(new)
                s, e, r = s[x], e[np.append(x[1:], len(e)) - 1] + least - 1, r[x]
                text = u.data[np.repeat(s, e - s) + within(e - s)[1]]
                off = np.concatenate([[0], np.cumsum(e - s)])
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(text)])
                t = pa.table({"row": u.row[r], "start": u.start[r] + s - u.off[r], "id": u.doc[r], "text": body})
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([_zip(t)], pa.binary())], ["unit", "blob"])

    return run


def _pack(m, key, doc, row, at, wide) -> bytes:
    """Runs as bytes: the small numbers compressed, 48 bits of each name as they are."""
    small = b"".join([doc.tobytes(), row.astype(np.uint32).tobytes(), at.tobytes(), wide.astype(np.uint32).tobytes()])
    z = pa.compress(small, codec="zstd", asbytes=True)
    big = b"".join([x for v in (m, key) for x in ((v >> np.uint64(32)).astype(np.uint32).tobytes(), ((v >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes())])
    return struct.pack("<II", len(m), len(z)) + z + big


def _unpack(z: bytes):
    n, size = struct.unpack_from("<II", z)
    small = pa.decompress(z[8 : 8 + size], 24 * n, codec="zstd", asbytes=True)
    doc, row = np.frombuffer(small, np.int64, n), np.frombuffer(small, np.uint32, n, 8 * n)
    at, wide = np.frombuffer(small, np.int64, n, 12 * n), np.frombuffer(small, np.uint32, n, 20 * n)
    out, p = [], 8 + size
    for _ in range(2):
        hi, lo = np.frombuffer(z, np.uint32, n, p), np.frombuffer(z, np.uint16, n, p + 4 * n)
        out.append(hi.astype(np.uint64) << np.uint64(16) | lo)
        p += 6 * n
    return out[0], out[1], doc, row.astype(np.int64), at, wide.astype(np.int64)


def _merge(owner_: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Overlapping or touching spans of one owner joined; sorted by owner."""
    o = np.lexsort((s, owner_))
    w, s, e = owner_[o], s[o], e[o]
    if not len(w):
        return w, s, e
    # the farthest end so far, started anew at each owner
    base = np.cumsum(np.concatenate([[0], w[1:] != w[:-1]])) * (int(e.max()) + 1)
    far = np.maximum.accumulate(e + base)
    at = np.flatnonzero(np.concatenate([[True], (s + base)[1:] > far[:-1]]))
    return w[at], s[at], np.maximum.reduceat(e, at)


def _grouped(key: np.ndarray, *cols):
    """A value of key and its columns' values interleaved as bytes, for each; key is sorted."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    flat = np.stack([c.astype(np.int64) for c in cols], 1)
    return key[at], [flat[x:y].tobytes() for x, y in zip(at.tolist(), [*at[1:].tolist(), len(key)])]


def _spans_batch(unit: np.ndarray, row: np.ndarray, s: np.ndarray, e: np.ndarray, names_: list[str]) -> pa.RecordBatch:
    """Rows of merged spans by unit: (row, from, to); the other columns are null."""
    pair = np.empty(len(unit), np.dtype([("u", "<i8"), ("r", "<i8")]))
    pair["u"], pair["r"] = unit, row
    kinds, who = np.unique(pair, return_inverse=True)
    who, s, e = _merge(who, s, e)
    unit, blobs = _grouped(kinds["u"][who], kinds["r"][who], s, e)
    none = pa.nulls(len(unit), pa.binary())
    cols = {"unit": pa.array(unit), "spans": pa.array(blobs, pa.binary()), "bucket": pa.array(unit & 0xFFFF)}
    return pa.RecordBatch.from_arrays([cols.get(c, none) for c in names_], names_)


LAST = "bucket long, unit long, blob binary, spans binary"
FOUND = "unit long, spans binary, open binary"


def _last(least, buckets):
    """Units of open stretches -> runs packed by bucket; of a unit's equal spans only the smallest document's goes on."""

    @tidy
    def run(batches):
        for b in batches:
            for unit, blob in zip(b["unit"].to_pylist(), b["blob"]):
                u = Stretches(blob.as_buffer(), least)
                got = []
                for i, a, z, o in _parts(u.off, least):
                    m, s, e, r = anchors(u.data[a:z], o, least, K)
                    got.append((m, _span_names(_prefix(u.data[a:z]), s, e + least - 1), a + s, e - s, i + r))
                if not got:
                    continue
                m, key, at, wide, r = map(np.concatenate, zip(*got))
                if not len(m):
                    continue
                doc, row, at = u.doc[r], u.row[r], u.start[r] + at - u.off[r]
                o = np.lexsort((doc, key, m))
                m, key, doc, row, at, wide = (x[o] for x in (m, key, doc, row, at, wide))
                new = np.concatenate([[True], (m[1:] != m[:-1]) | (key[1:] != key[:-1])])
                more = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                if more.any():
                    yield _spans_batch(np.full(int(more.sum()), unit), row[more], at[more], at[more] + wide[more] + least - 1, ["bucket", "unit", "blob", "spans"])
                m, key, doc, row, at, wide = (x[~more] for x in (m, key, doc, row, at, wide))
                d = ((m >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                o = np.lexsort((row, d))
                head = np.flatnonzero(np.concatenate([[True], d[o][1:] != d[o][:-1]]))
                blobs = [_pack(*(x[o[i:j]] for x in (m, key, doc, row, at, wide))) for i, j in zip(head, [*head[1:], len(o)])]
                yield pa.RecordBatch.from_arrays([pa.array(d[o][head]), pa.array(np.full(len(head), unit)), pa.array(blobs, pa.binary()), pa.nulls(len(head), pa.binary())], ["bucket", "unit", "blob", "spans"])

    return run


def _decide(least):
    """Of a partition's runs: decided spans, and the runs that need their windows compared."""

    @tidy
    def run(batches):
        got = []
        for b in batches:
            rest = b.filter(b["blob"].is_null())
            if len(rest):
                yield pa.RecordBatch.from_arrays([rest["unit"], rest["spans"], pa.nulls(len(rest), pa.binary())], ["unit", "spans", "open"])
            some = b.filter(b["blob"].is_valid())
            for unit, z in zip(some["unit"].to_pylist(), some["blob"].to_pylist()):
                x = _unpack(z)
                got.append((*x, np.full(len(x[0]), unit)))
        if not got:
            return
        m, key, doc, row, at, wide, unit = (np.concatenate(x) for x in zip(*got))
        del got
        # ranks of one document are unique and leave
        o = np.argsort(m, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], m[o][1:] != m[o][:-1]]))
        n, d = np.diff(np.append(head, len(o))), doc[o]
        keep = o[np.repeat(np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head), n)]
        if not len(keep):
            return
        keep = keep[np.lexsort((doc[keep], key[keep], m[keep]))]
        m, key, doc, row, at, wide, unit = (x[keep] for x in (m, key, doc, row, at, wide, unit))
        nm = np.concatenate([[True], m[1:] != m[:-1]])
        nk = nm | np.concatenate([[True], key[1:] != key[:-1]])
        low = doc[np.flatnonzero(nk)][np.cumsum(nk) - 1]
        kinds = np.add.reduceat(nk.astype(np.int64), np.flatnonzero(nm))[np.cumsum(nm) - 1]
        dup = doc > low
        if dup.any():
            yield _spans_batch(unit[dup], row[dup], at[dup], at[dup] + wide[dup] + least - 1, ["unit", "spans", "open"])
        # of a document's equal spans one is enough, as what it's compared with has a smaller or larger id
        todo = np.flatnonzero(~dup & (kinds > 1))
        if len(todo):
            todo = todo[np.lexsort((at[todo], row[todo], unit[todo]))]
            ids, blob = _grouped(unit[todo], m[todo], row[todo], at[todo], wide[todo])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.binary()), pa.array(blob, pa.binary())], ["unit", "spans", "open"])

    return run


WIN = np.dtype([("m", "<u8"), ("doc", "<i8"), ("unit", "<i8"), ("row", "<i8"), ("at", "<i8"), ("wide", "<i8")])


def _bytes_pass(least, buckets):
    """(unit, blob, open) -> the open runs with their bytes, packed by bucket."""

    @tidy
    def run(batches):
        for b in batches:
            for unit, blob, open_ in zip(b["unit"].to_pylist(), b["blob"], b["open"].to_pylist()):
                u = Stretches(blob.as_buffer(), least)
                v = np.frombuffer(b"".join(open_), np.int64).reshape(-1, 4)
                place = np.empty(len(u.row), np.dtype([("r", "<i8"), ("s", "<i8")]))
                place["r"], place["s"] = u.row, u.start
                want = np.empty(len(v), place.dtype)
                want["r"], want["s"] = v[:, 1], v[:, 2]
                o = np.argsort(place)
                p = o[np.searchsorted(place[o], want, "right") - 1]
                w = np.empty(len(v), WIN)
                w["m"], w["doc"], w["unit"], w["row"], w["at"], w["wide"] = v[:, 0].view(np.uint64), u.doc[p], unit, v[:, 1], v[:, 2], v[:, 3]
                lens, from_ = v[:, 3] + least - 1, u.off[p] + v[:, 2] - u.start[p]
                d = ((w["m"] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(d, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], d[o][1:] != d[o][:-1]]))
                blobs = []
                for i, j in zip(head, [*head[1:], len(o)]):
                    r = o[i:j]
                    raw = w[r].tobytes() + u.data[np.repeat(from_[r], lens[r]) + within(lens[r])[1]].tobytes()
                    blobs.append(struct.pack("<II", len(r), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(d[o][head]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _windows(least):
    """Packed open runs of a partition -> spans whose windows' bytes occur in a smaller document."""

    @tidy
    def run(batches):
        got = []
        for b in batches:
            for z in b["blob"].to_pylist():
                n, size = struct.unpack_from("<II", z)
                raw = pa.decompress(z[8:], size, codec="zstd", asbytes=True)
                got.append((np.frombuffer(raw, WIN, n), np.frombuffer(raw, np.uint8, -1, n * WIN.itemsize)))
        if not got:
            return
        w, data = (np.concatenate(x) for x in zip(*got))
        lens = w["wide"] + least - 1
        first = np.cumsum(lens) - lens
        name, run_of, start = [], [], []
        for i, j in slabs(np.concatenate([[0], np.cumsum(lens)]), SLAB):
            p = _prefix(data[first[i] : first[j - 1] + lens[j - 1]])
            k = within(w["wide"][i:j])[1]
            s = np.repeat(first[i:j] - first[i], w["wide"][i:j]) + k
            name.append(_span_names(p, s, s + least))
            run_of.append(np.repeat(np.arange(i, j), w["wide"][i:j]))
            start.append(k)
        name, run_of, start = map(np.concatenate, (name, run_of, start))
        doc = w["doc"][run_of]
        o = np.lexsort((doc, name))
        name = name[o]
        new = np.concatenate([[True], name[1:] != name[:-1]])
        # neighbours with one name are compared byte by byte
        at = first[run_of[o]] + start[o]
        view = np.lib.stride_tricks.sliding_window_view(data, least)
        same = np.flatnonzero(~new)
        for i in range(0, len(same), 1 << 17):
            q = same[i : i + (1 << 17)]
            new[q[(view[at[q]] != view[at[q - 1]]).any(1)]] = True
        low = doc[o][np.flatnonzero(new)][np.cumsum(new) - 1]
        dup = np.zeros(len(o), bool)
        dup[o] = doc[o] > low
        s, e = runs(dup, np.flatnonzero(np.concatenate([start == 0, [True]])))
        if len(s):
            r = run_of[s]
            a = w["at"][r] + start[s]
            yield _spans_batch(w["unit"][r], w["row"][r], a, a + (e - s) + least - 1, ["unit", "spans"])

    return run


def _cover(size: int, v: np.ndarray) -> np.ndarray:
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, v[:, 1], 1)
    np.add.at(step, v[:, 2], -1)
    return np.cumsum(step)[:size] > 0


def _beside(units: DataFrame, lists: DataFrame, buckets: int, out: str, how: str = "inner") -> DataFrame:
    """units with each one's rows of lists as the array `out`; both sides are dealt over `buckets` tasks, which grow with the input."""
    name = next(c for c in lists.columns if c != "unit") if len(lists.columns) == 2 else None
    item = F.col(name) if name else F.struct(*[c for c in lists.columns if c != "unit"])
    return units.repartition(buckets, "unit").join(lists.repartition(buckets, "unit").groupBy("unit").agg(F.collect_list(item).alias(out)), "unit", how)


def _round(units: DataFrame, least: int, k: int, buckets: int) -> DataFrame:
    """One round: the units' ranks of k bytes are dealt, sorted and marked; the units narrowed to what isn't unique."""
    marks = units.mapInArrow(_emit(least, k, buckets), "bucket long, unit long, list binary").repartition(buckets, "bucket")
    marks = cut(marks.mapInArrow(_rerank, "unit long, bucket long, bits binary"), "ranks")
    release(units.sparkSession)
    out = cut(_beside(units, marks, buckets, "marks").mapInArrow(_narrow(least, k, buckets), "unit long, blob binary"), "open")
    drop_cut(marks)
    release(units.sparkSession)
    return out


def _spans(df: DataFrame, least: int, text: str, buckets: int) -> DataFrame:
    """(unit, blob, all): the stored units of df's rows (columns id, text and others), and the removed spans (null: none)."""
    if least < K:
        raise ValueError(f"at least {K} bytes")
    spark = df.sparkSession
    small_batches(spark)
    units = cut(df.mapInArrow(_store(text), "unit long, blob binary"), "units")
    open_, h = units, K
    while h < least:
        narrower = _round(open_, least, h, buckets)
        if open_ is not units:
            drop_cut(open_)
        open_, h = narrower, 2 * h
    found = open_.mapInArrow(_last(least, buckets), LAST).repartition(buckets, "bucket").mapInArrow(_decide(least), FOUND)
    found = cut(found, "found")
    release(spark)
    late = _beside(open_, found.where("open is not null").select("unit", "open"), buckets, "open").mapInArrow(_bytes_pass(least, buckets), "bucket long, blob binary")
    late = late.repartition(buckets, "bucket").mapInArrow(_windows(least), "unit long, spans binary")
    done = cut(found.where("spans is not null").select("unit", "spans").union(late), "spans")
    drop_cut(found)
    drop_cut(open_)
    release(spark)
    return _beside(units, done, buckets, "all", "left")


def _rewritten(body, each):
    """mapInArrow over (unit, blob, all): each unit's table and a function that gives a row's covered bytes (None: none)."""

    @tidy
    def run(batches):
        for b in batches:
            for blob, spans in zip(b["blob"], b["all"].to_pylist()):
                t = pa.ipc.open_stream(pa.py_buffer(blob.as_buffer())).read_all().combine_chunks()
                data, off = column(t["text"])
                v = np.frombuffer(b"".join(spans or []), np.int64).reshape(-1, 3)
                v = v[np.argsort(v[:, 0], kind="stable")]
                edge = np.searchsorted(v[:, 0], np.arange(t.num_rows + 1))
                texts = [each(data[off[i] : off[i + 1]], v[edge[i] : edge[i + 1]]) for i in range(t.num_rows)]
                yield from body(t, texts, np.diff(off))

    return run


def _named(df: DataFrame, doc_id: str, text: str, others: list[str]) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"o_{i}") for i, c in enumerate(others)])


def digests(df: DataFrame, least: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Removed is each byte covered by a string of `least` bytes that also starts in a document with a smaller id.
    Null and empty texts have no bytes. A document of repeated rows (one id) removes nothing from its own rows; rows
    with a null id neither remove nor lose anything. An empty table gives no rows. Other columns are not read.
    """

    def each(t, v):
        if not len(v):
            return 0, 0, hashlib.sha256(t).hexdigest()
        c = _cover(len(t), v)
        return int(c.sum()), int((c[1:] & ~c[:-1]).sum() + c[:1].sum()), hashlib.sha256(t[~c]).hexdigest()

    def body(t, texts, size):
        removed, spans, sha = zip(*texts) if texts else ((), (), ())
        yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], [doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _spans(_named(df, doc_id, text, []), least, "text", parts_for(df)).mapInArrow(_rewritten(body, each), f"`{doc_id}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, least: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its repeated strings removed from `text`, all columns kept in order.

    A character that is only partly removed goes whole, so texts stay valid. Null stays null; repeated rows (one id)
    remove nothing from each other, rows with a null id stay as they are, an empty table gives no rows.
    """
    others = [c for c in df.columns if c not in (doc_id, text)]
    named = _named(df, doc_id, text, others)

    def each(t, v):
        if not len(v):
            return t
        c = _cover(len(t), v)
        lead = np.flatnonzero((t & 0xC0) != 0x80)
        return t[~np.repeat(np.maximum.reduceat(c, lead), np.diff(np.append(lead, len(t))))]

    def body(t, texts, _):
        null = t["text"].is_null().to_pylist()
        new = pa.array([None if n else x.tobytes().decode("utf-8") for n, x in zip(null, texts)], pa.string())
        yield from t.set_column(t.column_names.index("text"), "text", new).to_batches(max_chunksize=4096)

    got = _spans(named, least, "text", parts_for(df)).mapInArrow(_rewritten(body, each), named.schema)
    back = {doc_id: "id", text: "text"} | {c: f"o_{i}" for i, c in enumerate(others)}
    return got.select(*[F.col(back[c]).cast(df.schema[c].dataType).alias(c) for c in df.columns])


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS p FROM n WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
x AS (SELECT w.r, w.p, CASE WHEN w.p - lag(w.p) OVER (PARTITION BY w.r ORDER BY w.p) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.first),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM x),
sp AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY r, g),
k AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM sp GROUP BY r),
pc AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM sp UNION ALL SELECT r, max(b), max(n) FROM sp JOIN n USING (r) GROUP BY r),
t AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM pc JOIN n USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
