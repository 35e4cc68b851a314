"""Shards by vector bin packing: bytes, tokens and rows balanced jointly.

Groups of equal texts stay together unless one would fill over half a shard; such a group is dealt out in pieces. An
item goes, largest first, to the shard where its vector has the highest dot product with the residual capacity, among
those with room in all dimensions as long as there are such. Groups with at least 1/BIG of a shard are packed first, on
the driver (there are at most 3 * shards * BIG of them) together with bins of all others: where the small groups lie
after they were counted, each partition packs its own into bins of equal capacity, group by group, and the driver packs
the bins' sums. There are some BINS bins over all partitions, or one a partition where there are more partitions, so the
balance doesn't depend on how many there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, input_bytes, parts_for

BIG = 64
BINS = 8192  # of small groups, over all partitions
GROUPS_MB = 32  # of counted groups for one packing task
DIMS = ("size", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int, level: bool = True) -> np.ndarray:
    """The shard of each item (a row of bytes, tokens, rows); all shards have an equal share of each sum as capacity."""
    v = vectors.astype(np.float64) / np.maximum(vectors.sum(0), 1) * shards
    rest = np.ones((shards, v.shape[1]))
    out = np.empty(len(v), np.int64)
    for i in np.lexsort((np.arange(len(v)), -v.sum(1), -v.max(1))).tolist():
        x = v[i]
        dot = rest @ x
        fits = (rest >= x).all(1)
        out[i] = s = int((np.where(fits, dot, -np.inf) if fits.any() else dot).argmax())
        rest[s] -= x
    return _level(v, out, rest) if level else out


def _level(v: np.ndarray, out: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Swap items with equal rows between the fullest and the emptiest shard as long as that levels their bytes."""
    for _ in range(8 * len(rest)):
        hi, lo = int(rest[:, 0].argmin()), int(rest[:, 0].argmax())
        gap = rest[lo, 0] - rest[hi, 0]
        a, b = np.flatnonzero(out == hi), np.flatnonzero(out == lo)
        a, b = a[:: max(1, len(a) // 256)], b[:: max(1, len(b) // 256)]
        if gap < 1e-6 or not len(a) or not len(b):
            break
        d = v[a, 0][:, None] - v[b, 0][None]
        d[np.abs(v[a, 2][:, None] - v[b, 2][None]) > 1e-12] = -1
        off = np.where(d > 0, np.abs(d - gap / 2), np.inf)
        i, j = np.unravel_index(off.argmin(), off.shape)
        if not off[i, j] < gap / 2:
            break
        rest[hi] += v[a[i]] - v[b[j]]
        rest[lo] -= v[a[i]] - v[b[j]]
        out[a[i]], out[b[j]] = lo, hi
    return out


def rendezvous(key: Column, shards: int) -> Column:
    """The shard whose hash with the key is largest: one more shard only takes rows into itself."""
    k = key.cast("string")
    at = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(k, s).alias("h"), (-s).alias("s")))
    return (-F.array_max(at)["s"]).cast("int")


def _numbered(df: DataFrame, by: list[str], subs: int, out: str) -> DataFrame:
    """df with `out`, 0, 1, 2 ... within `by`, by the stored number u, without bringing the rows of one value to one task."""
    d = df.withColumn("sub", F.pmod(F.xxhash64("u"), F.lit(subs)))
    n = d.groupBy(*by, "sub").count()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = n.withColumn("base", F.sum("count").over(w.orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)))
    d = d.join(n.select(*by, "sub", F.coalesce("base", F.lit(0)).alias("base")), [*by, "sub"])
    at = F.row_number().over(Window.partitionBy(*by, "sub").orderBy("u"))
    return d.withColumn(out, (F.col("base") + at - 1).cast("long")).drop("sub", "base")


def shard(df: DataFrame, shards: int = 40, law: str = "bytes", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    law: `bytes` (sizes near equal, by vector bin packing), `rows` (counts at most one apart) or `key` (the id and
    the number of shards decide; grown_shard has the shard among one more). size is the text's UTF-8 bytes plus 16,
    text_crc32 its CRC-32; a null text counts as empty but is a group of its own. Tokens are words between white
    space. Rows with a null id and repeated rows are placed like any others; an empty table gives no rows; other
    columns are not read.
    """
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"no such law: {law}")
    t = F.coalesce(F.col(text), F.lit(""))
    subs = max(64, 4 * parts_for(df) // shards)
    rows = df.select(
        F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("u"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null")).alias("g"),
    )
    rows = cut(rows, "sizes")  # u is read again
    none = F.lit(None).cast("int")
    if law == "key":
        out = rows.withColumns({"shard": rendezvous(F.col("id"), shards), "grown_shard": rendezvous(F.col("id"), shards + 1)})
    elif law == "rows":
        out = _numbered(rows, [], subs * shards, "at").withColumns({"shard": (F.col("at") % shards).cast("int"), "grown_shard": none})
    else:
        out = _packed(rows, shards).withColumn("grown_shard", none)
    out = _numbered(out, ["shard"], subs, "slot")
    return out.select(F.col("id").alias(doc_id), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def _packed(rows: DataFrame, shards: int) -> DataFrame:
    """rows with `shard`."""
    spark = rows.sparkSession
    vec = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = cut(rows.groupBy("g").agg(*vec), "groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS]).first()
    share = F.greatest(*[F.col(d) * (shards / max(total[d] or 0, 1)) for d in DIMS])
    big = groups.withColumn("share", share).where(F.col("share") * BIG >= 1).orderBy(F.desc("share"), "g").collect()
    # a group of equal texts over half a shard is dealt out, by numbers of rows, and never in more pieces than rows
    pieces = [1 if r["share"] <= 0.5 else min(r["rows"], int(np.ceil(4 * r["share"]))) for r in big]
    items = [[r[d] / r["rows"] * ((r["rows"] - i - 1) // n + 1) for d in DIMS] for r, n in zip(big, pieces) for i in range(n)]

    parts = max(1, int(input_bytes(groups) / (GROUPS_MB * 2**20)))
    named = F.broadcast(spark.createDataFrame([(r["g"],) for r in big], "g string"))

    def fill(batches):
        got = [b for b in batches if len(b)]
        if got:
            p = pd.concat(got).sort_values("g")
            bins = max(1, max(BINS, BIG * shards) // parts)
            at = np.arange(len(p)) if len(p) <= bins else pack(p[list(DIMS)].to_numpy(), bins, level=False)
            yield p.assign(bin=at + (TaskContext.get().partitionId() << 32))

    small = cut(groups.join(named, "g", "left_anti").repartition(parts, "g").mapInPandas(fill, "g string, size long, tokens long, rows long, bin long"), "bins")
    sums = small.groupBy("bin").agg(*[F.sum(d).alias(d) for d in DIMS]).orderBy("bin").collect()
    vectors = np.array(items + [[b[d] for d in DIMS] for b in sums], np.float64).reshape(-1, len(DIMS))
    where = pack(vectors, shards).tolist() if len(vectors) else []
    first = (np.cumsum(pieces) - pieces).tolist() if pieces else []
    large = F.broadcast(spark.createDataFrame([(r["g"], where[i : i + n]) for r, i, n in zip(big, first, pieces)], "g string, places array<int>"))
    bins = F.broadcast(spark.createDataFrame([(b["bin"], s) for b, s in zip(sums, where[len(items) :])], "bin long, shard int"))
    # no small group has many rows, large ones never enter this shuffle
    some = rows.join(large, "g", "left")
    most = some.where("size(places) = 1").withColumn("shard", F.element_at("places", 1)).drop("places")
    dealt = _numbered(some.where("size(places) > 1"), ["g"], BIG, "at").withColumn("shard", F.element_at("places", (F.col("at") % F.size("places") + 1).cast("int"))).drop("places", "at")
    rest = some.where("places is null").drop("places").join(small.select("g", "bin"), "g").join(bins, "bin").drop("bin")
    return rest.unionByName(most).unionByName(dealt)
