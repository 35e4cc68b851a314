"""Passages of words that occur anywhere else, in another document or the same, are removed.

A window is `width` consecutive words. It is counted by its anchor: the run of SHINGLE words in it with the smallest
hash, the first of equals. Equal windows have equal anchors at equal distances, so a window that occurs twice has an
anchor that does; neighbouring windows mostly share theirs, which leaves one anchor for some twelve windows.

* Prefilter: each partition counts its anchors in a count-min sketch and emits the cells that it touched; the sketches
  are merged cell by cell, in blocks. Cells only overestimate, so an anchor with a cell under two occurs once, and so
  do all of its windows. The merged sketch has a size set from the input's, at most MOST_CELLS cells a row, and goes to
  the tasks as bits (24 MB at most). Beyond some 30 million anchors it fills up and holds back fewer; the second
  pass is exact for any that it lets through and grows with their number only.
* Second pass: the windows of an anchor form a span of words. Spans are grouped by anchor and 128-bit digest of their
  words: a span that occurs twice is repeated throughout. Only where an anchor has different spans (at the ends of
  passages), the windows of the distinct spans are grouped one by one, by anchor and window hash (128 bits together).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop_cut, input_bytes, parts_for, release, small_batches, unused
from .textnp import SPACE, column, gather, mix, owner, piece_hash, runs, tidy, within

SHINGLE = 12
ROWS = 3
MOST_CELLS = 1 << 26  # of a row of the sketch
BLOCK = 1 << 16
HELD = 1 << 20  # anchors of a partition that are counted together
KEY = ["kd", "kh", "kn"]


def _joint(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, from those of powers of two."""
    out, done, part, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = len(part) - done
                out, done = mix(out[:n] * np.uint64(0x9E3779B97F4A7C15) + part[done:] + np.uint64(size)), done + size
        if size * 2 > k:
            return out
        part = mix(part[: len(part) - size] * np.uint64(0xD6E8FEB86659FD95) + part[size:] + np.uint64(size))
        size *= 2


def _first_least(v: np.ndarray, q: int) -> np.ndarray:
    """Of each q consecutive values, the place of the least, the first of equals."""
    at, size = np.arange(len(v)), 1
    while size < q:
        step = min(size, q - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(v[b] < v[a], b, a)
        size += step
    return at


class Words:
    """The words of a batch of texts, and the anchors of its windows."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = column(texts)
        self.start, self.end = runs(~SPACE[self.data], self.off)
        self.row = owner(self.off, self.start)

    def anchors(self, width: int):
        """Hash of each anchor, and its windows: first, last (the places of their first words); hashes of all windows by place."""
        k, n = min(SHINGLE, width), len(self.start)
        none = np.zeros(0, np.int64)
        if n < width:
            return none.astype(np.uint64), none, none, none.astype(np.uint64)
        h = piece_hash(self.data, self.start, self.end)
        s = _joint(h, k)
        at = _first_least(s, width - k + 1)
        whole = np.flatnonzero(self.row[: n - width + 1] == self.row[width - 1 :])
        if not len(whole):
            return none.astype(np.uint64), none, none, none.astype(np.uint64)
        a = at[whole]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        return s[a[first]], whole[first], whole[last], _joint(h ^ np.uint64(0x5851F42D4C957F2D), width)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All bytes with one space after each word, and where each word begins and ends in them."""
        size = self.end - self.start
        flat, _, at = gather(self.data, self.start, self.end)
        first, _ = within(size + 1)
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        out[np.repeat(first, size) + at] = flat
        return out.tobytes(), first, first + size


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h + np.uint64(0x2545F4914F6CDD1D) * np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(width: int, bits: int):
    """Texts -> (block, once, more): the cells of a block that this partition's anchors hit once and more often."""
    blocks = 1 << (bits - 16)

    def touched(h: np.ndarray) -> pa.RecordBatch:
        out = []
        for r in range(ROWS):
            c, n = np.unique(_cells(h, r, bits), return_counts=True)
            ends = np.append(np.flatnonzero(np.diff(c >> 16)) + 1, len(c))
            low, more = (c & 0xFFFF).astype(np.uint16), n > 1
            for i, j in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                x, m = low[i:j], more[i:j]
                out.append((r * blocks + int(c[i] >> 16), x[~m].tobytes(), x[m].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["block", "once", "more"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            h = Words(b.column(0)).anchors(width)[0]
            held.append(h)
            n += len(h)
            if n >= HELD:
                yield touched(np.concatenate(held))
                held, n = [], 0
        if n:
            yield touched(np.concatenate(held))

    return tidy(run)


def _merge(batches):
    """Partition sketches of whole blocks -> (block, twice): a bit for each cell that was hit at least twice."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, once, more in zip(*(b.column(i).to_pylist() for i in range(3))):
            c = held.setdefault(block, np.zeros(BLOCK, np.uint8))
            for cells, n in ((once, 1), (more, 2)):
                p = np.frombuffer(cells, np.uint16)
                c[p] = np.minimum(c[p] + n, 2)
    for block, c in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(c > 1).tobytes()], pa.binary())], names=["block", "twice"])


def prefilter(spark: SparkSession, texts: DataFrame, width: int) -> tuple[int, bytes]:
    """(bits, table): log2 of the sketch's cells in a row, and one bit for each cell of each row, set if hit at least twice."""
    size = input_bytes(texts)
    if size >= 1 << 60:  # no files: text bytes, about twice what a file would have
        size = (texts.agg(F.sum(F.octet_length(texts.columns[0]).cast("long"))).first()[0] or 0) // 2
    # a window's anchor comes every 50 bytes of a compressed file, twice as many cells
    bits = int(np.clip(int(np.ceil(np.log2(max(size, 1) / 25))), 16, int(np.log2(MOST_CELLS))))
    blocks = ROWS << (bits - 16)
    found = texts.mapInArrow(_sketch(width, bits), "block int, once binary, more binary").repartition(max(1, min(blocks, parts_for(texts, 64))), "block")
    table = bytearray(blocks * BLOCK // 8)
    for block, twice in found.mapInArrow(_merge, "block int, twice binary").toLocalIterator():
        table[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = twice
    return bits, bytes(table)


def _occurrences(width: int, bits: int, table):
    """(key, text) -> key, anchor, span digest, first and last window, window hashes of each span that may be repeated."""

    def run(batches):
        twice = np.frombuffer(table.value, np.uint8)
        for b in batches:
            w = Words(b.column(3))
            h, first, last, hashes = w.anchors(width)
            keep = np.ones(len(h), bool)
            for r in range(ROWS):
                c = _cells(h, r, bits) + (r << bits)
                keep &= (twice[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
            h, first, last = h[keep], first[keep], last[keep]
            if not len(h):
                continue
            text, at, to = w.joined()
            spans = [hashlib.blake2b(text[i:j], digest_size=16).digest() for i, j in zip(at[first].tolist(), to[last + width - 1].tolist())]
            n = last - first + 1
            flat, _, _ = gather(hashes, first, last + 1)
            row = w.row[first]
            base = np.searchsorted(w.row, row)
            key = [b.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*key, pa.array(h.view(np.int64)), pa.array(spans, pa.binary()), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat.view(np.int64)))],
                names=[*KEY, "anchor", "span", "first", "last", "hashes"],
            )

    return tidy(run)


def repeats(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, marks): key, text of every row, and for each key with such windows the spans of words (from, to) that repeated ones cover."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(doc_id).alias("kd"), F.xxhash64(text).alias("kh"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("kn"), F.col(text).alias("t"))
    bits, table = prefilter(spark, docs.select(F.col(text).alias("t")), width)
    sent = spark.sparkContext.broadcast(table)
    kind = docs.schema[doc_id].dataType.simpleString()
    occ = cut(base.mapInArrow(_occurrences(width, bits, sent), f"kd {kind}, kh long, kn int, anchor long, span binary, first int, last int, hashes array<long>"), "occurrences")
    release(spark)
    # everything that is joined is read from files, so that Spark can split the frequent anchors of either side
    spans = cut(occ.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes")), "spans")
    ends = cut(spans.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "ends")
    wins = cut(spans.join(ends, "anchor").select("anchor", "span", "n", F.posexplode("hashes").alias("i", "w")), "windows")
    same = cut(wins.groupBy("anchor", "w").agg(F.sum("n").alias("c")).where("c > 1").select("anchor", "w"), "repeated")
    single = wins.where("n = 1").join(same, ["anchor", "w"]).groupBy("anchor", "span").agg(F.collect_list("i").alias("some"))  # at most width windows of one span
    known = cut(spans.where("n > 1").select("anchor", "span", F.lit(None).cast("array<int>").alias("some")).unionByName(single), "known")
    hit = occ.select(*KEY, "anchor", "span", "first", "last").join(known, ["anchor", "span"])
    all_of = F.array(F.struct(F.col("first").alias("a"), (F.col("last") + width).alias("b")))
    some = F.transform("some", lambda i: F.struct((F.col("first") + i).alias("a"), (F.col("first") + i + width).alias("b")))
    marks = cut(hit.select(*KEY, F.when(F.col("some").isNull(), all_of).otherwise(some).alias("x")).groupBy(*KEY).agg(F.flatten(F.collect_list("x")).alias("x")), "marks")
    for df in (occ, spans, ends, wins, same, known):
        drop_cut(df)
    sent.unpersist()
    release(spark)
    return base, marks.select(*KEY, F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def _kept(texts: DataFrame, marks: DataFrame, schema: str, rows) -> DataFrame:
    """Each text with its marks; rows(batch, words, joined text, places, dropped) gives the batch's output."""
    m = marks.select(*[F.col(k).alias(f"m{k}") for k in KEY], "a", "b")
    j = texts.join(m, texts["kd"].eqNullSafe(m["mkd"]) & (texts["kh"].eqNullSafe(m["mkh"])) & (texts["kn"] == m["mkn"]), "left").drop("mkd", "mkh", "mkn")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            w = Words(b.column("t"))
            base = np.searchsorted(w.row, np.arange(b.num_rows + 1))
            diff = np.zeros(len(w.start) + 1, np.int64)
            a, e = b.column("a"), b.column("b")
            n = np.asarray(a.value_lengths().fill_null(0))
            shift = np.repeat(base[:-1], n)
            np.add.at(diff, np.asarray(a.flatten(), np.int64) + shift, 1)
            np.add.at(diff, np.asarray(e.flatten(), np.int64) + shift, -1)
            gone = np.cumsum(diff[:-1]) > 0
            left = Words.__new__(Words)
            left.data, left.start, left.end, left.row = w.data, w.start[~gone], w.end[~gone], w.row[~gone]
            text, at, to = left.joined() if len(left.start) else (b"", left.start, left.end)
            first = np.searchsorted(left.row, np.arange(b.num_rows + 1))
            out = [text[at[i] : to[j - 1]] if j > i else b"" for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            yield rows(b, np.diff(base), np.diff(base) - np.diff(first), out)

    return j.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Words are runs of other bytes than white space, unchanged. A word goes if any window over it also begins anywhere
    else, as the input stands; kept words are joined by one space. Null and empty texts, and those of fewer words than
    a window, lose nothing; a repeated row is a repetition; rows with a null id are treated by their texts; other
    columns are not read.
    """
    name = docs.schema[doc_id].dataType.simpleString()

    def rows(b, words, gone, kept):
        return pa.RecordBatch.from_arrays([b.column("kd"), pa.array(words), pa.array(gone), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=["d", "n_words", "n_removed", "kept_sha256"])

    texts, marks = repeats(docs, width, doc_id, text)
    return _kept(texts, marks, f"d {name}, n_words long, n_removed long, kept_sha256 string", rows).select(F.col("d").alias(doc_id), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages cut out of the text; texts that lose none stay as they are, the rest are kept words joined by a space."""
    name, gone = docs.schema[doc_id].dataType.simpleString(), unused(docs, "__gone")

    def rows(b, words, lost, kept):
        return pa.RecordBatch.from_arrays([*[b.column(k) for k in KEY], pa.array(lost), pa.array([x.decode() for x in kept])], names=[*KEY, "n", "kept"])

    texts, marks = repeats(docs, width, doc_id, text)
    some = texts.join(marks.select(*[F.col(k).alias(f"s{k}") for k in KEY]), F.col("kd").eqNullSafe(F.col("skd")) & (F.col("kh") == F.col("skh")) & (F.col("kn") == F.col("skn")), "left_semi")
    new = _kept(some.dropDuplicates(KEY), marks, f"kd {name}, kh long, kn int, n long, kept string", rows).where("n > 0").select(*[F.col(k).alias(f"{gone}{k}") for k in KEY], F.col("kept").alias(gone))
    same = F.col(doc_id).eqNullSafe(F.col(f"{gone}kd")) & (F.xxhash64(docs[text]) == F.col(f"{gone}kh")) & (F.octet_length(docs[text]) == F.col(f"{gone}kn"))
    out = docs.join(new, same, "left")
    return out.select(*[F.coalesce(gone, docs[text]).alias(c) if c.lower() == text.lower() else docs[c] for c in docs.columns])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT r, a, array_to_string(w[a:a + 34], ' ') AS win FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS a FROM d)),
k AS (SELECT r, a FROM (SELECT r, a, count(*) OVER (PARTITION BY win) AS n FROM v) WHERE n > 1),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(generate_series(a, a + 34)) AS p FROM k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
