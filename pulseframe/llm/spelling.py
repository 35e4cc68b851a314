"""Spelling variants: words one edit apart, grouped under their most frequent near word.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times: an inserted or deleted letter
flips one bit, a replaced one two. Of the mask's three bands at least one is therefore equal in near words. Bands of
some 30 letters alone hold thousands of words each, so that the pairs of a bucket would grow with its square; the edit
also lies in one half of the word, and the join takes equal bands together with an equal other half and lengths at most
one apart. Pairs are given by the first key that they share, and verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]"
BANDS = 3


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least `least` code points and `often` occurrences.

    If `every` divides the CRC-32 of "<doc_id>:<run>", the run loses one code point, at the CRC modulo its length (a
    null id counts as empty). Null and empty texts have no words; a repeated row counts again.
    """
    # a run that is too short stays so when it loses a letter
    w = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("w")).withColumn("w", F.translate("w", UPPER, LOWER))
    w = w.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("w")).cast("binary")))
    w = w.withColumn("at", (F.col("h") % F.length("w")).cast("int"))
    less = F.expr("concat(substring(w, 1, at), substring(w, at + 2))")
    w = w.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("w")).alias("word")).where(F.length("word") >= least)
    return w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def bands(word: Column) -> list[Column]:
    """The mask's bands as integers: letters are dealt to the bands in turn."""
    codes = F.transform(F.split(word, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26))

    def fold(b: int) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1), F.floor(i / BANDS).cast("int"))
        return F.aggregate(codes, F.lit(0), lambda m, i: m.bitwiseXOR(F.when(i % BANDS == b, bit(i)).otherwise(0)))

    return [fold(b) for b in range(BANDS)]


def _halves(word: Column, short: Column) -> list[Column]:
    """What an edit in the other half leaves alone, for words of `short` code points or one more."""
    h = F.floor(short / 2).cast("int")
    return [F.substring(word, F.lit(1), h), F.call_function("right", word, short - h)]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words that are one inserted, deleted or replaced code point apart, once; a is not the longer."""
    w = words.select("word", "n", F.length("word").alias("size"), *[c.alias(f"m{i}") for i, c in enumerate(bands(F.col("word")))])
    w = cut(w, "masks")

    def keyed(df: DataFrame, name: str) -> DataFrame:
        sides = _halves(F.col("word"), F.col("short"))
        keys = F.explode(F.array(*[F.struct(F.lit(BANDS * s + b).alias("k"), F.xxhash64(F.col("short"), F.lit(BANDS * s + b), half, F.col(f"m{b}")).alias("h")) for s, half in enumerate(sides) for b in range(BANDS)]))
        return df.select("*", keys.alias("x")).select("x.h", "x.k", *[F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "size", *[f"m{i}" for i in range(BANDS)])])

    a = keyed(w.withColumn("short", F.col("size")), "a")
    b = keyed(w.withColumn("short", F.explode(F.array(F.col("size"), F.col("size") - 1))), "b")
    x, y = F.col("a_word"), F.col("b_word")
    band = F.coalesce(*[F.when(F.col(f"a_m{i}") == F.col(f"b_m{i}"), i) for i in range(BANDS)])
    side = F.when(_halves(x, F.col("a_size"))[0] == _halves(y, F.col("a_size"))[0], 0).otherwise(1)
    once = (a["k"] == b["k"]) & (a["k"] == BANDS * side + band)
    order = (F.col("b_size") == F.col("a_size") + 1) | ((F.col("b_size") == F.col("a_size")) & (x < y))
    found = a.join(b, (a["h"] == b["h"]) & order & once & (F.levenshtein(x, y, 1) == 1))
    return found.select(x.alias("a"), F.col("a_n"), y.alias("b"), F.col("b_n"))


def forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, form, form_n, n_near: of each word its near words counted, and the most frequent one (ties: the smallest), if that is `ratio` times as frequent."""
    p = near_pairs(words)
    both = p.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("w"), F.col("b_n").alias("k")), F.struct(F.col("b").alias("word"), F.col("a").alias("w"), F.col("a_n").alias("k")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), F.col("w"))).alias("best"))
    enough = -F.col("best.k") >= ratio * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.k")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of count_words(); form and form_n as forms() gives them.

    root follows the forms to the last one; a form is at least `ratio` (2 or more) times as frequent as its word, so
    chains end, and their number of steps is at most the logarithm of the largest count. Without words, no rows.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its word")
    words = cut(count_words(docs, doc_id, text, least, often, every), "words")
    out = cut(forms(words, ratio), "forms")
    up = cut(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # pointers are doubled
        far = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = cut(up.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = nxt.where("moved").limit(1).count()
        drop_cut(up)
        up = nxt
        if not moved:
            break
    drop_cut(words)
    return out.join(up.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS x FROM documents),
l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM r WHERE length(x) >= 7 GROUP BY 1, 2),
b AS (SELECT w, k, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)) AS bytes FROM l),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM b, t),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, k FROM h),
n AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT DISTINCT a.word AS word, b.word AS near, b.n AS k FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM d a JOIN n b ON a.less = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM d a JOIN n b ON a.less = b.word),
c AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, max(k) AS k, min(near) FILTER (WHERE k = top) AS near FROM (SELECT *, max(k) OVER (PARTITION BY word) AS top FROM p) GROUP BY word),
f AS (SELECT n.word AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN k >= 10 * n THEN near END AS form, CASE WHEN k >= 10 * n THEN k END AS form_n FROM n LEFT JOIN c USING (word)),
u AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT u.word, f.word, f.form FROM u JOIN f ON u.up = f.word)
SELECT f.word AS word, form, u.root AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN u ON f.word = u.word AND u.up IS NULL
"""
