"""What the operators share: shared storage, sizes, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.session import ship

BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set, a local session gets one of its own; on a cluster that would lose data, so it is an error.
    """
    ship(spark)
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pulseframe-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder and read back: lost executors can't take it, and the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pulseframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove what cut() wrote, once nothing reads it again."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, once a session and the same for all operators, so that long texts don't make huge ones."""
    ship(spark)
    conf = spark._jsparkSession.sessionState().conf()
    if conf.arrowMaxBytesPerBatch() > BATCH_BYTES or conf.arrowMaxBytesPerBatch() <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, mb: int = 8) -> int:
    """How many partitions of about mb MB of the input; never fewer than the session's shuffle partitions."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    # rows that don't come from files have no estimate, which Spark gives as a number near 2^63
    return few if size >= 1 << 60 else max(few, min(1_000_000, size // (mb << 20)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links reduced to one (member, smallest id of its component) for each other member."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = lo != hi
        if not open_.any():
            break
        x, y, lo, hi = x[open_], y[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    k = np.flatnonzero(root != np.arange(len(ids)))
    return ids[k], ids[root[k]]


def _contract(batches):
    got = [b for b in batches if len(b)]
    if got:
        p = pd.concat(got)
        u, v = forest(p["u"].to_numpy(np.int64), p["v"].to_numpy(np.int64))
        for i in range(0, len(u), 100_000):
            yield pd.DataFrame({"u": u[i : i + 100_000], "v": v[i : i + 100_000]})


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of integer ids -> (u, v): every linked id but the smallest of its component, with that smallest id.

    Each partition first reduces its own links to a forest; then large-star and small-star rounds
    (Kiveris et al., 2014) run until the links stop changing. A hub's links are split by the skew join.
    No links give no rows.
    """
    e = cut(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInPandas(_contract, "u long, v long"), "links")
    seen = None
    while True:
        # large-star: to each larger neighbour, the smallest of the neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: (u > v) everything not larger than u goes to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        nxt = cut(small.mapInPandas(_contract, "u long, v long"), "links")
        now = nxt.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        drop_cut(e)
        e = nxt
        if seen == now and now[0] == now[2]:
            return e
        seen = now
