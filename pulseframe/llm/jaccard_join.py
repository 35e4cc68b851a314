"""Documents linked by the Jaccard similarity of their word n-gram sets, exactly.

1. Every whole text is read twice. The first pass gives each document its number of shingles and a bitmap signature
   (one bit a shingle, at least twice as many bits as shingles), and counts all shingles of all documents in a table
   of fixed size; shingles are ordered by their counter, so that frequent ones come last.
2. In that common order two sets above the threshold share a shingle among their first n - ceil(t n) + 1. The second
   pass sends those, packed by hash range; each shingle's documents form a group, and the group's smallest id names
   the block its members belong to. Pairs that share any such shingle are thus members of one block.
3. Members are compared with their block's first document, then, with a signature tree, with each other as far as they
   aren't connected yet: nodes hold the OR (and AND) of their members' bitmaps and the range of set sizes, and a dual
   traversal drops node pairs whose largest possible overlap is too small. What remains is verified on whole texts.
Copies within a batch are linked where they are read. Blocks of over BLOCK members are split in pairs of chunks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, drop_cut, forest, parts_for, small_batches
from .textnp import column, mix, shingles, slabs, tidy

COUNTERS = 1 << 22
CHUNKS = 16
SALTS = 8
SLAB = 2 << 20
FLUSH = 1_000_000  # postings held by a task before they are packed
BLOCK = 4096
LEAF, FAN = 32, 8
FILTER_BITS = 1 << 23


def _need(n, num, den):
    """The least overlap of a set of size n with any set at the threshold num/den."""
    return -(-num * n // den)


def _sets(a: pa.Array, k: int):
    """Row ranges of a column with their shingle sets: (first row, values, offsets)."""
    data, off = column(a)
    for i, j in slabs(off, SLAB):
        v, o = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
        yield i, v, o


def _sum(v: np.ndarray, o: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, v.dtype), np.cumsum(v, dtype=v.dtype)])
    return c[o[1:]] - c[o[:-1]]


def _widths(n: np.ndarray) -> np.ndarray:
    """Bits of the signatures: a power of two, at least 2 n and 64."""
    return (1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)).astype(np.int64)


def signatures(v: np.ndarray, o: np.ndarray) -> list[bytes]:
    n = np.diff(o)
    w = _widths(n)
    first = np.concatenate([[0], np.cumsum(w)])
    bits = np.zeros(int(first[-1]), bool)
    row = np.repeat(np.arange(len(n)), n)
    bits[first[row] + (mix(v) & (w[row] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    at = (first // 8).tolist()
    return [packed[x:y] for x, y in zip(at, at[1:])]


def _first_pass(k):
    @tidy
    def run(batches):
        table, any_ = np.zeros(COUNTERS, np.uint32), False
        for b in batches:
            n, fp, sig = [], [], []
            for _, v, o in _sets(b.column(1), k):
                any_ = True
                np.add.at(table, (v & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                n.append(np.diff(o))
                fp.append((_sum(mix(v), o) ^ mix(np.diff(o).astype(np.uint64))).view(np.int64))
                sig += signatures(v, o)
            n, fp = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, fp))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(fp), pa.array(sig, pa.binary()), pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.int32())], ["id", "n", "fp", "sig", "chunk", "salt"])
        if any_:
            parts = table.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64())] * 3 + [pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary()), pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(np.full(CHUNKS, int(table[:997].sum()) % SALTS, np.int32))], ["id", "n", "fp", "sig", "chunk", "salt"])

    return run


def _add_tables(batches):
    held: dict[tuple, np.ndarray] = {}
    for b in batches:
        for c, s, z in zip(b["chunk"].to_pylist(), b["salt"].to_pylist(), b["sig"].to_pylist()):
            t = np.frombuffer(zlib.decompress(z), np.uint32).astype(np.int64)
            held[c, s] = held[c, s] + t if (c, s) in held else t
    for (c, s), t in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.minimum(t, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary()), pa.array([c], pa.int32()), pa.array([s], pa.int32())], ["sig", "chunk", "salt"])


def _classes(first: DataFrame) -> np.ndarray:
    """How full each counter is, in quarters of the deviation that chance alone gives: a table of fixed size."""
    t = first.where("chunk is not null").select("sig", "chunk", "salt")
    kind = "sig binary, chunk int, salt int"
    t = t.repartition(CHUNKS * SALTS, "chunk", "salt").mapInArrow(_add_tables, kind).withColumn("salt", F.lit(0))
    t = t.repartition(CHUNKS, "chunk").mapInArrow(_add_tables, kind)
    count = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.int64)
    for r in t.collect():
        count[r["chunk"]] = np.frombuffer(zlib.decompress(r["sig"]), np.uint32)
    c = count.ravel()
    mean, step = c.mean(), max(1.0, np.sqrt(c.mean()) / 4)
    low = np.maximum((c - mean) / step + 16, 0)
    return np.where(low < 64, low, np.minimum(64 + 8 * np.log2(np.maximum(low / 64, 1)), 255)).astype(np.uint8)


def _second_pass(k, num, den, classes, buckets):
    @tidy
    def run(batches):
        cls = np.frombuffer(zlib.decompress(classes), np.uint8)
        tok, ids, size, held = [], [], [], 0

        def packed():
            t, d, n = (np.concatenate(x) for x in (tok, ids, size))
            at = (t >> np.uint64(40)).astype(np.int64) % buckets
            o = np.argsort(at, kind="stable")
            t, d, n, at = t[o], d[o], n[o].astype(np.int32), at[o]
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            blobs = [_blob(t[x:y], d[x:y], n[x:y]) for x, y in zip(cuts, [*cuts[1:], len(t)])]
            return pa.RecordBatch.from_arrays([pa.array(at[cuts].astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(cuts), pa.int64()), pa.nulls(len(cuts), pa.int64())], ["bucket", "blob", "u", "v"])

        for b in batches:
            id_ = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seen: dict[tuple, int] = {}
            u, w = [], []
            for i, v, o in _sets(b.column(1), k):
                n = np.diff(o)
                row = np.repeat(np.arange(len(n)), n)
                fp, fp2 = _sum(mix(v), o), _sum(mix(v ^ np.uint64(0x5BF03635)), o)
                fresh = np.zeros(len(n), bool)
                for r, key in enumerate(zip(n.tolist(), fp.tolist(), fp2.tolist())):
                    if key[0]:
                        if (was := seen.setdefault(key, int(id_[i + r]))) == id_[i + r]:
                            fresh[r] = True
                        else:
                            u.append(int(id_[i + r]))
                            w.append(was)
                order = np.lexsort((v, cls[(v & np.uint64(COUNTERS - 1)).astype(np.int64)], row))
                at = np.arange(len(v)) - o[:-1][row]
                take = order[(at < (n - _need(n, num, den) + 1)[row]) & fresh[row]]
                tok.append(v[take])
                ids.append(id_[i + row[take]])
                size.append(n[row[take]])
                held += len(take)
            if u:
                a, c = forest(np.array(u), np.array(w))
                yield pa.RecordBatch.from_arrays([pa.array((a % buckets).astype(np.int32)), pa.nulls(len(a), pa.binary()), pa.array(a), pa.array(c)], ["bucket", "blob", "u", "v"])
            if held > FLUSH:
                yield packed()
                tok, ids, size, held = [], [], [], 0
        if held:
            yield packed()

    return run


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(x.tobytes() for x in arrays)


def _groups(num, den):
    """Of a partition's postings: (block, member) rows, and the links of copies."""

    @tidy
    def run(batches):
        t, d, n = [], [], []
        for b in batches:
            some = b.filter(b["blob"].is_valid())
            rest = b.filter(b["blob"].is_null())
            if len(rest):
                yield pa.RecordBatch.from_arrays([rest["u"], rest["v"], pa.array(np.ones(len(rest), np.int8))], ["a", "b", "same"])
            for z in some["blob"].to_pylist():
                m = len(z) // 20
                t.append(np.frombuffer(z, np.uint64, m))
                d.append(np.frombuffer(z, np.int64, m, 8 * m))
                n.append(np.frombuffer(z, np.int32, m, 16 * m))
        if not t:
            return
        t, d, n = map(np.concatenate, (t, d, n))
        # only shingles of more than one document, only members with another of a fitting size
        o = np.argsort(t, kind="stable")
        t, d, n = t[o], d[o], n[o].astype(np.int64)
        more = np.zeros(len(t) + 1, bool)
        more[1:-1] = t[1:] == t[:-1]
        k = more[:-1] | more[1:]
        t, d, n = t[k], d[k], n[k]
        o = np.lexsort((d, n, t))
        t, d, n = t[o], d[o], n[o]
        fit = np.zeros(len(t) + 1, bool)
        fit[1:-1] = (t[1:] == t[:-1]) & (n[:-1] * den >= n[1:] * num)
        k = fit[:-1] | fit[1:]
        t, d = t[k], d[k]
        if not len(t):
            return
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        block = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(t))))
        o = np.lexsort((d, block))
        block, d = block[o], d[o]
        k = np.concatenate([[True], (block[1:] != block[:-1]) | (d[1:] != d[:-1])]) & (block != d)
        block, d = block[k], d[k]
        for i in range(0, len(d), 50_000):
            c = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(d[c]), pa.array(block[c]), pa.array(np.zeros(len(d[c]), np.int8))], ["a", "b", "same"])

    return run


def _words64(sigs: list[bytes], width: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, folded to the width."""
    w = width // 64
    out = np.zeros((len(sigs), w), np.uint64)
    for i, s in enumerate(sigs):
        x = np.frombuffer(s, np.uint64)
        out[i] = x if len(x) == w else np.bitwise_or.reduce(x.reshape(-1, w), axis=0)
    return out


def _possible(na, nb, a_only, b_only, num, den):
    """Whether sets of these sizes can reach the threshold with so many elements proven to be in one only."""
    most = np.minimum(na - a_only, nb - b_only)
    return most * (num + den) >= num * (na + nb)


def _pops(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def pair_possible(na, nb, sa: list[bytes], sb: list[bytes], num, den) -> np.ndarray:
    """By signatures alone, which pairs can reach the threshold."""
    na, nb = np.asarray(na, np.int64), np.asarray(nb, np.int64)
    ok = (na > 0) & (nb > 0) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
    width = np.minimum(_widths(na), _widths(nb))
    for w in np.unique(width[ok]).tolist():
        r = np.flatnonzero(ok & (width == w))
        for i in range(0, len(r), max(64, (1 << 22) // w)):
            q = r[i : i + max(64, (1 << 22) // w)]
            a, b = _words64([sa[x] for x in q.tolist()], w), _words64([sb[x] for x in q.tolist()], w)
            ok[q] = _possible(na[q], nb[q], _pops(a & ~b), _pops(b & ~a), num, den)
    return ok


class Tree:
    """Members sorted by size; levels of nodes with OR and AND of the bitmaps and the range of sizes."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        self.n, self.bits = n, bits
        lo, hi, any_, all_ = n, n, bits, bits
        self.levels = []
        step = LEAF
        while True:
            at = np.arange(0, len(lo), step)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            any_, all_ = np.bitwise_or.reduceat(any_, at, axis=0), np.bitwise_and.reduceat(all_, at, axis=0)
            self.levels.append((lo, hi, any_, all_))
            if len(at) == 1:
                break
            step = FAN

    def children(self, level: int, node: int) -> range:
        top = len(self.levels[level - 1][0]) if level else len(self.n)
        step = FAN if level else LEAF
        return range(node * step, min(top, (node + 1) * step))


def dual(x: Tree, y: Tree, num, den):
    """Pairs of members (rows of x, rows of y) that the nodes and their bitmaps can't rule out; of one tree, each pair once."""
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    same = x is y
    while stack:
        lx, i, ly, j = stack.pop()
        if same and lx == ly and i > j:
            continue
        (xl, xh, xa, xe), (yl, yh, ya, ye) = x.levels[lx], y.levels[ly]
        if xh[i] * den < yl[j] * num or yh[j] * den < xl[i] * num:
            continue
        if not (same and lx == ly and i == j):
            most = min(xh[i] - _pops(xe[i] & ~ya[j]), yh[j] - _pops(ye[j] & ~xa[i]))
            if most * den < num * max(xl[i], yl[j]):
                continue
        if lx or ly:
            if lx >= ly:
                stack += [(lx - 1, c, ly, j) for c in x.children(lx, i)] if not (same and lx == ly) else [(lx - 1, c, ly - 1, e) for c in x.children(lx, i) for e in y.children(ly, j)]
            else:
                stack += [(lx, i, ly - 1, c) for c in y.children(ly, j)]
            continue
        p, q = np.array(x.children(0, i)), np.array(y.children(0, j))
        a, b = x.bits[p][:, None], y.bits[q][None]
        ok = _possible(x.n[p][:, None], y.n[q][None], _pops(a & ~b), _pops(b & ~a), num, den)
        if same and i == j:
            ok &= p[:, None] < q[None]
        r, c = np.nonzero(ok)
        yield p[r], q[c]


def block_pairs(n, sigs, comp, num, den):
    """Pairs of a block's members of different components that the signature trees leave: two arrays of rows."""
    n = np.asarray(n, np.int64)
    width = _widths(n)
    left, right = [], []
    trees = {}
    for w in np.unique(width[n > 0]).tolist():
        r = np.flatnonzero((width == w) & (n > 0))
        r = r[np.argsort(n[r], kind="stable")]
        some = [sigs[i] for i in r.tolist()]
        trees[w] = (r, Tree(n[r], _words64(some, w)), some)
    for w, (r, t, _) in trees.items():
        todo = [(r, t)]
        if 2 * w in trees:
            r2, t2, s2 = trees[2 * w]
            todo.append((r2, Tree(t2.n, _words64(s2, w))))
        for r2, t2 in todo:
            for p, q in dual(t, t2, num, den):
                a, b = r[p], r2[q]
                k = comp[a] != comp[b]
                left.append(a[k])
                right.append(b[k])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _tree_pass(num, den):
    """Rows (block, part, id, n, sig, comp) sorted by block and part -> (a, b) candidates."""

    def blocks(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            key = np.stack([t["block"].to_numpy(), t["part"].to_numpy()])
            at = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) if t.num_rows else np.zeros(0, int)
            for i, j in zip(at, at[1:]):
                yield t.slice(i, j - i)
            left = t.slice(at[-1]) if len(at) else None
        if left is not None and left.num_rows:
            yield left

    @tidy
    def run(batches):
        out_a, out_b, held = [], [], 0
        for t in blocks(batches):
            if t.num_rows < 2:
                continue
            ids, comp, block = t["id"].to_numpy(), t["comp"].to_numpy(), t["block"][0].as_py()
            if (comp == comp[0]).all():
                continue
            x, y = block_pairs(t["n"].to_numpy(), t["sig"].to_pylist(), comp, num, den)
            a, b = np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])
            k = (b != block) & (a != b)  # pairs with the block's first are done
            if k.any():
                out_a.append(a[k])
                out_b.append(b[k])
                held += int(k.sum())
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a, out_b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _prune_pass(num, den):
    @tidy
    def run(batches):
        for b in batches:
            ok = pair_possible(b["na"].to_numpy(), b["nb"].to_numpy(), b["sa"].to_pylist(), b["sb"].to_pylist(), num, den)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok))

    return run


def _verify_pass(k, num, den):
    """Rows (a, b, ta, tb), sorted by a -> links (u, v): the sets of the whole texts decide."""

    def sets(a: pa.Array, ids: np.ndarray):
        new = pa.compute.not_equal(a.slice(1), a.slice(0, len(a) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | new]))
        same = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        got = []
        for _, v, o in _sets(a.take(pa.array(first)), k):
            got += [v[x:y] for x, y in zip(o[:-1].tolist(), o[1:].tolist())]
        return [got[i] for i in same.tolist()]

    @tidy
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            ua, ub = b["a"].to_numpy(), b["b"].to_numpy()
            sa, sb = sets(b["ta"], ua), sets(b["tb"], ub)
            ok = np.zeros(len(ua), bool)
            for i, (x, y) in enumerate(zip(sa, sb)):
                if len(x) and len(y) and min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    inter = int((both[1:] == both[:-1]).sum())
                    ok[i] = den * inter >= num * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([pa.array(ua[ok]), pa.array(ub[ok])], ["u", "v"])

    return run


def _filter_table(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size of the ids; false hits only cost time."""

    @tidy
    def run(batches):
        t = np.zeros(FILTER_BITS, bool)
        for b in batches:
            t[(mix(b["id"].to_numpy().astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        if t.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(t).tobytes(), 1)], pa.binary())], ["bits"])

    def add(batches):
        t = None
        for b in batches:
            for z in b["bits"].to_pylist():
                x = np.frombuffer(zlib.decompress(z), np.uint8)
                t = x if t is None else t | x
        if t is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(t.tobytes(), 1)], pa.binary())], ["bits"])

    got = ids.mapInArrow(run, "bits binary").repartition(8).mapInArrow(add, "bits binary").collect()
    t = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in got:
        t = t | np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return t


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of candidate (a, b) pairs, the links (u, v)."""
    table = zlib.compress(_filter_table(pairs.select(F.explode(F.array("a", "b")).alias("id"))).tobytes(), 1)

    def some(batches):
        t = np.unpackbits(np.frombuffer(zlib.decompress(table), np.uint8)).astype(bool)
        for b in batches:
            keep = t[(mix(b.column(0).to_numpy().astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
            if keep.any():
                yield b.filter(pa.array(keep))

    t = docs.mapInArrow(some, "id long, text string")
    ta = t.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = t.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verify_pass(k, num, den), "u long, v long")


def link_documents(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of characters other than white space, A-Z lower-cased; the set holds the distinct k-word shingles,
    of fewer words the whole sequence, of a null text or one without words nothing. Documents link when the
    intersection is at least num/den of the union; empty sets link with nothing. component_id is the smallest id
    reachable by links. Rows with one id count as one document in the links (each keeps its own n_shingles); rows
    with a null id link with nothing and have a null component. Other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    first = cut(docs.mapInArrow(_first_pass(k), "id long, n long, fp long, sig binary, chunk int, salt int"), "sets")
    classes = zlib.compress(_classes(first).tobytes(), 1)
    # never few, so that a pair which shares several shingles comes from about as many buckets at every size
    buckets = max(64, parts_for(df))
    known = docs.where("id is not null")
    posts = known.mapInArrow(_second_pass(k, num, den, classes, buckets), "bucket int, blob binary, u long, v long")
    stars = cut(posts.repartition(buckets, "bucket").mapInArrow(_groups(num, den), "a long, b long, same byte"), "blocks")
    member = stars.where("same = 0").select("a", "b").distinct()
    sig = first.where("chunk is null and id is not null and n > 0").select("id", "n", "sig")
    one = member.join(sig.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    one = one.join(sig.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    pairs = cut(one.mapInArrow(_prune_pass(num, den), "a long, b long").distinct(), "pairs")
    links = cut(_verified(known, pairs, k, num, den).union(stars.where("same = 1").select("a", "b")), "links")
    comp = components(links)
    # the rest of each block, as far as its members aren't connected yet
    inside = member.select("a", "b").union(member.select(F.col("b").alias("a"), "b").distinct()).withColumnsRenamed({"a": "id", "b": "block"})
    inside = inside.join(comp.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    inside = cut(inside, "inside")
    open_ = inside.groupBy("block").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y and size > 2")
    open_ = open_.select("block", F.ceil(F.col("size") / BLOCK).cast("int").alias("s"))
    part = F.pmod(F.xxhash64("id"), F.col("s")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda x: F.least(x, part) * F.col("s") + F.greatest(x, part))
    rest = inside.join(open_, "block").join(sig, "id").select("block", F.explode(both).alias("part"), "id", "n", "sig", "comp")
    rest = rest.repartition("block", "part").sortWithinPartitions("block", "part")
    more = cut(rest.mapInArrow(_tree_pass(num, den), "a long, b long").distinct(), "pairs")
    if not more.isEmpty():
        links = cut(_verified(known, more, k, num, den).union(links), "links")
        comp = components(links)
    out = first.where("chunk is null").select("id", "n").join(comp, F.col("id") == F.col("u"), "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("v", "id").alias("component_id"))


def keep_one(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that are their component's smallest id, with all columns; rows with a null id stay. Of repeated rows of one id the smallest text stays."""
    comp = link_documents(df, k, num, den, doc_id, text)
    marks = comp.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.bool_or(F.col(doc_id) != F.col("component_id")).alias("gone"), F.count("*").alias("n"))
    marks = cut(marks.where("gone or n > 1"), "marks")
    again = marks.where("not gone").select("__id")
    if again.isEmpty():
        return df.join(marks, df[doc_id] == marks["__id"], "left_anti")
    ones = df.join(marks, df[doc_id] == marks["__id"], "left_anti")
    rows = df.join(again, df[doc_id] == again["__id"], "left_semi")
    # a minimum, not a window, so that one id's rows are reduced before they are shuffled
    rest = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    least = F.struct(F.col(text).isNull(), F.col(text), F.xxhash64(*rest))
    return ones.union(rows.groupBy(doc_id).agg(F.min_by(F.struct("*"), least).alias("__row")).select("__row.*"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[a:a + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS a FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
p AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS u, doc_id AS c FROM d UNION SELECT p.u, r.c FROM r JOIN p ON p.v = r.u),
c AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.c AS BIGINT) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.u = d.doc_id
"""
