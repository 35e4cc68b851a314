"""Near-duplicate embeddings by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the two form a product grid of cells, in which every vector is
filed once. A query takes the cells in the order of a lower bound on its distance to anything in them (the sum over the
halves of the squared distance to the cell's border) by a multi-sequence traversal of its two sorted lists of borders,
and stops when the bound passes the largest distance that a pair above the threshold can have: its recall is then 1, as
tests check against brute force. Of two cells only the one with the smaller number queries the other. What lies in the
visited cells is verified in double precision.

A query travels once for each group of cells that it visits (GROUP vectors or so of one label), with the list of these
cells. Groups of more than CAP vectors are split, and their queries go to each part; a task holds one part's vectors and
streams the queries past them. Exact copies are filed once, with their number, and a task gives counts and a spanning
forest of the links it found, so that dense groups don't become pairs of rows. The codebooks are fitted on at most
SAMPLE vectors; every vector is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, drop_cut, forest, small_batches
from .textnp import tidy

SAMPLE = 16_384
GROUP, CAP = 4096, 8192
SLACK = 1e-9


def fit_half(v: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k-means centres; fewer where there are fewer different vectors."""
    v = np.unique(v, axis=0)
    k = min(k, len(v))
    c = v[np.random.default_rng(seed).choice(len(v), k, replace=False)] if k else v
    for _ in range(rounds if k > 1 else 0):
        a = _squares(v, c).argmin(1)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, v)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _squares(v, c):
    return np.maximum((v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1), 0)


def bounds(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and the squares of lower bounds on its distance to every cell's region."""
    if not len(c):
        return np.zeros(len(v), np.int64), np.zeros((len(v), 1))
    d = _squares(v, c)
    own = d.argmin(1)
    gap = np.sqrt(_squares(c, c))
    gap[gap == 0] = np.inf
    low = np.maximum(d - d[np.arange(len(v)), own][:, None], 0) / (2 * gap[own])
    low[np.arange(len(v)), own] = 0
    return own, low * low


def _unit(a: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a list column whose lists are equally long."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    v = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _halves(v):
    h = v.shape[1] // 2
    return v[:, :h], v[:, h:]


def traverse(low_a: np.ndarray, low_b: np.ndarray, reach: float):
    """The product cells of each query, nearest bound first, until the bound passes reach: (query, first cell, second cell), visit by visit.

    A multi-sequence traversal of all queries at once: each first-half cell has a head in the sorted list of second-half
    cells; the smallest sum of all heads is taken and its head moves on.
    """
    n = len(low_a)
    ra, rb = max(1, int((low_a <= reach).sum(1).max(initial=0))), max(1, int((low_b <= reach).sum(1).max(initial=0)))
    oa, ob = np.argsort(low_a, 1, kind="stable")[:, :ra], np.argsort(low_b, 1, kind="stable")[:, :rb]
    a = np.take_along_axis(low_a, oa, 1)
    b = np.concatenate([np.take_along_axis(low_b, ob, 1), np.full((n, 1), np.inf)], 1)
    head = np.zeros((n, ra), np.int64)
    key = a + b[:, :1]
    live, got = np.arange(n), []
    while len(live):
        r = key[live].argmin(1)
        go = key[live, r] <= reach
        live, r = live[go], r[go]
        h = head[live, r]
        got.append((live, oa[live, r], ob[live, h]))
        head[live, r] = h + 1
        key[live, r] = a[live, r] + b[live, h + 1]
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (z, z, z)


def verify(q: np.ndarray, t: np.ndarray, least: float):
    """Pairs (row of q, row of t) whose cosine is at least `least`, in blocks; near the threshold by an exact sum."""
    for k in range(0, len(q), 4096):
        some = q[k : k + 4096]
        for m in range(0, len(t), 1024):
            part = t[m : m + 1024]
            cos = some @ part.T
            for x, y in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):
                cos[x, y] = math.fsum((some[x] * part[y]).tolist())
            x, y = np.nonzero(cos >= least)
            yield k + x, m + y


def _grouped(batches, key: list[str]):
    """Arrow batches sorted by the key -> (is it the group's first piece, piece) in order."""
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b[c] for c in key]
        new = np.zeros(len(b), bool)
        for c in cols:
            new[1:] |= pa.compute.not_equal(c.slice(1), c.slice(0, len(b) - 1)).to_numpy(zero_copy_only=False)
        at = [0, *np.flatnonzero(new).tolist(), len(b)]
        for i, j in zip(at, at[1:]):
            this = tuple(c[i].as_py() for c in cols)
            yield this != last, b.slice(i, j - i)
            last = this


def near_duplicates(df: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors are compared only where labels are equal and not null, and only with vectors as long as they. A null,
    empty or zero vector, or one with a null, infinite or NaN component, links with nothing and is its own component.
    n_links counts the other rows linked directly; repeated rows (one id twice) count as rows, each gets the id's
    result. Rows with a null id come back with null component and no links. Other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    reach = 2 - 2 * least + SLACK
    base = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>" if "float" in df.schema[embedding].dataType.simpleString() else "array<double>").alias("e"), F.col(label).alias("l"))
    good = F.col("l").isNotNull() & F.col("id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("e", lambda x: x != 0)
    # exact copies once; the key also holds the length
    one = cut(base.where(good).groupBy("l", "e").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors")
    dims = [r[0] for r in one.select(F.size("e").alias("d")).groupBy("d").count().orderBy(F.desc("count")).limit(64).collect()]
    total = one.count()
    top = one.groupBy("l").count().agg(F.max("count")).first()[0] or 1
    k = int(min(256, max(4, 2 ** round(math.log2(top) / 3))))
    books = {}
    for d in dims:
        got = one.where(F.size("e") == d).where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(1 << 20) * min(1.0, 1.5 * SAMPLE / max(total, 1) + 1e-4)).select("e").limit(SAMPLE).toArrow()["e"]
        v = _unit(got) if len(got) else np.zeros((0, d))
        books[d] = tuple(fit_half(x, k) if x.shape[1] else x[:1] for x in _halves(v))
    none = (np.zeros((0, 0)), np.zeros((0, 0)))
    # second-half cells that share a group
    wide = max(1, k // max(1, round(top / k / GROUP)))

    @tidy
    def file(batches):
        for b in batches:
            size = np.asarray(pa.compute.list_value_length(b["e"]))
            for d in np.unique(size).tolist():
                part = b.take(pa.array(np.flatnonzero(size == d)))
                book = books.get(d, none)
                for z in range(0, len(part), 1024):
                    some = part.slice(z, 1024)
                    h1, h2 = _halves(_unit(some["e"]))
                    own_a, low_a = bounds(h1, book[0])
                    own_b, low_b = bounds(h2, book[1])
                    q, i, j = traverse(low_a, low_b, reach)
                    keep = i * k + j >= (own_a * k + own_b)[q]
                    q, i, j = q[keep], i[keep], j[keep]
                    g = i * k + j // wide
                    o = np.lexsort((j, g, q))
                    q, j, g = q[o], j[o], g[o]
                    head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (g[1:] != g[:-1])])) if len(q) else np.zeros(0, np.int64)
                    lists = [j[x:y].astype(np.uint16).tobytes() for x, y in zip(head.tolist(), [*head[1:].tolist(), len(j)])]
                    who = np.concatenate([np.arange(len(some)), q[head]])
                    group = np.concatenate([own_a * k + own_b // wide, g[head]])
                    role = np.repeat(np.array([0, 1], np.int8), [len(some), len(head)])
                    lists = [x.tobytes() for x in own_b.astype(np.uint16)] + lists
                    own = own_a * k + own_b
                    out = some.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([out["l"], out["e"], out["rep"], out["n"], pa.array(np.full(len(who), d, np.int32)), pa.array(group), pa.array(role), pa.array(own[who]), pa.array(lists, pa.binary())], ["l", "e", "rep", "n", "d", "cell", "role", "own", "cells"])

    def links_of(t, q):
        """Links of a piece of queries with the held targets: a forest and both sides' counts."""
        tv, tid, tn, town, torder, tcut = t
        qid, qn, qown, qv = q["rep"].to_numpy(), q["n"].to_numpy(), q["own"].to_numpy(), _unit(q["e"])
        lists = q["cells"].to_pylist()
        lens = np.array([len(x) // 2 for x in lists])
        j = np.frombuffer(b"".join(lists), np.uint16).astype(np.int64)
        row = np.repeat(np.arange(len(q)), lens)
        o = np.argsort(j, kind="stable")
        edge = np.searchsorted(j[o], np.arange(k + 1))
        us, vs, cq, ct = [], [], np.zeros(len(q), np.int64), np.zeros(len(tid), np.int64)
        for c in np.unique(j).tolist():
            mine, near = torder[tcut[c] : tcut[c + 1]], row[o[edge[c] : edge[c + 1]]]
            if not len(mine):
                continue
            for x, y in verify(qv[near], tv[mine], least):
                x, y = near[x], mine[y]
                keep = (qown[x] != town[y]) | (qid[x] < tid[y])
                x, y = x[keep], y[keep]
                if len(x):
                    np.add.at(cq, x, tn[y])
                    np.add.at(ct, y, qn[x])
                    a, b = forest(qid[x], tid[y])
                    us.append(a)
                    vs.append(b)
        if not us:
            return None
        a, b = forest(np.concatenate(us), np.concatenate(vs))
        x, y = np.flatnonzero(cq), np.flatnonzero(ct)
        ids, num = np.concatenate([qid[x], tid[y]]), np.concatenate([cq[x], ct[y]])
        return pa.RecordBatch.from_arrays([pa.array([0] * len(a) + [1] * len(ids), pa.int32()), pa.array(np.concatenate([a, ids]).astype(np.int64)), pa.array(np.concatenate([b, num]).astype(np.int64))], ["kind", "u", "v"])

    @tidy
    def link(batches):
        held, ready = [], None
        for first, piece in _grouped(batches, ["l", "d", "cell", "chunk"]):
            if first:
                held, ready = [], None
            role = piece["role"].to_numpy()
            n_t = int((role == 0).sum())
            if n_t:
                held.append(piece.slice(0, n_t))
            q = piece.slice(n_t)
            if not len(q) or not held:
                continue
            if ready is None:
                t = pa.Table.from_batches(held)
                j = np.frombuffer(b"".join(t["cells"].to_pylist()), np.uint16).astype(np.int64)
                order = np.argsort(j, kind="stable")
                ready = (_unit(t["e"]), t["rep"].to_numpy(), t["n"].to_numpy(), t["own"].to_numpy(), order, np.searchsorted(j[order], np.arange(k + 1)))
            if (out := links_of(ready, q)) is not None:
                yield out

    kinds = {f.name: f.dataType.simpleString() for f in one.schema}
    filed = cut(one.select("l", "e", "rep", "n").mapInArrow(file, f"l {kinds['l']}, e {kinds['e']}, rep long, n long, d int, cell long, role byte, own long, cells binary"), "filed")
    # groups of more than CAP vectors: these in parts, the queries to each part
    hot = filed.where("role = 0").groupBy("l", "d", "cell").agg(F.ceil(F.count("*") / CAP).cast("int").alias("chunks")).where("chunks > 1")
    dealt = filed.join(hot, ["l", "d", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    to = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.select("l", "e", "rep", "n", "d", "cell", "role", "own", "cells", F.explode(to).alias("chunk"))
    dealt = dealt.repartition("l", "d", "cell", "chunk").sortWithinPartitions("l", "d", "cell", "chunk", "role")
    found = cut(dealt.mapInArrow(link, "kind int, u long, v long"), "found")
    drop_cut(filed)
    comp = components(found.where("kind = 0").select("u", "v")).select(F.col("u").alias("rep"), F.col("v").alias("component_id"))
    links = found.where("kind = 1").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("links"))
    reps = one.join(links, "rep", "left").join(comp, "rep", "left").select(F.col("l").alias("l_"), F.col("e").alias("e_"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    # invalid vectors have no partner in reps
    out = base.join(reps, (F.col("l") == F.col("l_")) & (F.col("e") == F.col("e_")), "left")
    comp_id = F.coalesce("component_id", "id").cast("long")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS c FROM embeddings UNION SELECT p.u, r.c FROM r JOIN p ON p.v = r.u),
c AS (SELECT u, min(c) AS c FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(c.c AS BIGINT) AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id
"""
