"""Benchmark decontamination with DataFrame operations only.

The benchmark's normalised word n-grams form a hash set, which is broadcast as far as its bytes allow. Documents are
scanned by windows: a window whose hash is in the set is verified word by word. To hash few windows, a literal set of
anchor words (the longest word of each n-gram, the first of equals) picks the places to look at, and the n-grams'
distances from their anchors give the windows that can begin there. Where the benchmark has too many anchors, every
window is hashed; where its n-grams are too large to broadcast, only (document, place, hash) go through a shuffle, and
the hits' documents are joined back to verify them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

N = 13
MAX_ANCHORS = 20_000  # words of the literal set
MAX_BYTES = 64 << 20  # of the n-grams that are broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The normalised words of a text; null has none."""
    w = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(w, lambda x: x != "")


def windows(items: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, win, anchor, shift): each distinct window of n words, its anchor and the anchor's place in it; a shorter item is one window."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("item is not null and size(w) > 0")
    w = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))).alias("at"))
    w = w.select("item", F.slice("w", F.col("at"), n).alias("win")).distinct()
    best = F.array_max(F.transform("win", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"))))
    return w.withColumn("shift", -best["i"]).withColumn("anchor", F.element_at("win", F.col("shift") + 1))


def _all_windows(w: str, widths: list[int]) -> Column:
    """(start, width, h) of every window of these widths of the words in column w."""
    def of(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("width"), F.xxhash64(F.slice(w, i, n)).alias("h")))

    return F.flatten(F.array(*[of(n) for n in widths]))


def hits(docs: DataFrame, wins: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key columns, start (from 1), width, item: each occurrence of a window in a text."""
    grams = wins.groupBy("win").agg(F.first("anchor").alias("anchor"), F.first("shift").alias("shift"), F.collect_set("item").alias("items"))
    grams = grams.select(F.xxhash64("win").alias("h"), "win", "items", "anchor", "shift", F.size("win").alias("width"))
    about = grams.agg(F.sum(F.octet_length(F.concat_ws(" ", "win")) + 16 * F.size("win") + 32).alias("bytes"), F.collect_set("width").alias("widths")).first()
    found = F.slice("w", F.greatest("start", F.lit(1)), F.col("width"))
    d = docs.select(*key, words_of(F.col(text)).alias("w"))
    if not about["widths"]:
        return d.where("false").select(*key, F.lit(1).alias("start"), F.lit(1).alias("width"), F.lit("").alias("item"))
    short = (about["bytes"] or 0) <= MAX_BYTES
    anchors = [r[0] for r in grams.select("anchor").distinct().limit(MAX_ANCHORS + 1).collect()] if short else []
    if short and len(anchors) <= MAX_ANCHORS:
        places = F.filter(F.transform("w", lambda x, i: F.when(x.isin(anchors), i)), lambda x: x.isNotNull())
        d = d.where(F.exists("w", lambda x: x.isin(anchors))).select(*key, "w", F.explode(places).alias("i")).withColumn("anchor", F.element_at("w", F.col("i") + 1))
        d = d.join(F.broadcast(grams.select("anchor", "shift", "width").distinct()), "anchor").withColumn("start", F.col("i") - F.col("shift") + 1)
        d = d.where((F.col("start") >= 1) & (F.col("start") + F.col("width") - 1 <= F.size("w"))).withColumn("h", F.xxhash64(found))
        got = d.drop("anchor", "width").join(F.broadcast(grams.select("h", "win", "width", "items")), "h")
        return got.where(found == F.col("win")).select(*key, "start", "width", F.explode("items").alias("item"))
    every = F.explode(_all_windows("w", sorted(about["widths"])))
    if short:
        d = d.select(*key, "w", every.alias("x")).select(*key, "w", "x.start", "x.h")
        got = d.join(F.broadcast(grams.select("h", "win", "width", "items")), "h")
        return got.where(found == F.col("win")).select(*key, "start", "width", F.explode("items").alias("item"))
    places = d.select(*key, every.alias("x")).select(*key, "x.*").join(grams.select("h", "width").distinct(), ["h", "width"])
    by = places.groupBy(*key).agg(F.collect_set(F.struct("start", "width")).alias("x")).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], "x")
    same = [d[c].eqNullSafe(by[f"k{i}"]) for i, c in enumerate(key)]
    d = d.join(by, same[0] & same[1] & same[2] if len(same) == 3 else same[0]).select(*key, "w", F.explode("x").alias("x"))
    d = d.select(*key, F.slice("w", F.col("x.start"), F.col("x.width")).alias("win"), "x.start", "x.width")
    return d.join(grams.select("win", "items"), "win").select(*key, "start", "width", F.explode("items").alias("item"))


def score(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, share: int = 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    A word is hit if it lies in any occurrence of a window; contaminated: some are, and `share` times their number
    reaches the number of words. Null and empty texts have no words and no hits; items without words, or without an
    id, have no windows; repeated rows give repeated results; other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("__d"), F.xxhash64(text).alias("__h"), F.coalesce(F.octet_length(F.col(text)), F.lit(-1)).alias("__n"), F.col(text).alias("__t"))
    key = ["__d", "__h", "__n"]
    found = hits(base, windows(items, n, item_id, item_text), key, "__t").distinct()
    spans = F.transform(F.collect_set(F.struct("start", "width")), lambda x: F.sequence(x["start"], x["start"] + x["width"] - 1))
    marks = found.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(spans))).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("ids"))
    marks = marks.select(*[F.col(k).alias(f"{k}_") for k in key], "n_hit", "ids")
    out = base.select(*key, F.size(words_of(F.col("__t"))).cast("long").alias("n_words"))
    out = out.join(marks, out["__d"].eqNullSafe(marks["__d_"]) & (out["__h"] == marks["__h_"]) & (out["__n"] == marks["__n_"]), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("__d").alias(doc_id), "n_words", hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that aren't contaminated, all their columns; rows without an id stay.

    Of repeated rows of one id all go if one of them is contaminated. Null and empty texts stay; an empty benchmark
    takes nothing away.
    """
    name = unused(docs, "__bad")
    bad = score(docs, items, doc_id, text, **how).where("contaminated").select(F.col(doc_id).alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(bad, docs[doc_id] == bad[name], "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, out: str = "clean_text") -> DataFrame:
    """All columns of docs, and `out`: the normalised words that no window hits, joined by a space; null where the text is null.

    A column that is named as `out` is replaced. Repeated rows and rows without an id are each treated by their text.
    """
    kept = docs.drop(out)
    h, n_bytes, gone_ = unused(kept, "__h"), unused(kept, "__n"), unused(kept, "__gone")
    base = kept.withColumns({h: F.xxhash64(text), n_bytes: F.coalesce(F.octet_length(F.col(text)), F.lit(-1))})
    key = [doc_id, h, n_bytes]
    found = hits(base, windows(items, n), key, text).distinct()
    word = found.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("p"))
    gone = word.groupBy(*key).agg(F.collect_set("p").alias(gone_)).select(*[F.col(k).alias(f"{gone_}{i}") for i, k in enumerate(key)], gone_)
    same = [base[k].eqNullSafe(gone[f"{gone_}{i}"]) for i, k in enumerate(key)]
    j = base.join(gone, same[0] & same[1] & same[2], "left")
    w = words_of(F.col(text))
    left = F.filter(F.transform(w, lambda x, i: F.when(F.col(gone_).isNull() | ~F.array_contains(gone_, i + 1), x)), lambda x: x.isNotNull())
    return j.select(*kept.columns, F.when(F.col(text).isNotNull(), F.concat_ws(" ", left)).alias(out))


SQL = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(w[a:a + 12], ' ') AS win, least(13, len(w)) AS width FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS a FROM i WHERE len(w) > 0 AND item IS NOT NULL)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT DISTINCT width FROM iw),
dw AS (SELECT r, width, a, array_to_string(w[a:a + width - 1], ' ') AS win FROM (SELECT r, w, width, unnest(generate_series(1, len(w) - width + 1)) AS a FROM d, l WHERE len(w) >= width)),
h AS (SELECT r, a, dw.width AS width, item FROM dw JOIN iw ON dw.win = iw.win AND dw.width = iw.width),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(a, a + width - 1)) AS p FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
