"""How filters interact: what each removes in every order, and what it alone removes.

Rows are first counted by part and failure flags (32 profiles of a part at five filters). CUBE over the flags and the
part gives, for each subset of flags, grouping-set rows; one whose selected flags are all false counts the documents
that survive that subset. Pairs of subsets that differ by one filter are joined: the difference is what the filter
removes after the others. Every step of every order looks its pair up, so no order is ever run over documents.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("docs", "good", "toxic")
MOST = 7  # filters: 5,040 orders of 7 steps for each part


def failures(text: Column) -> dict[str, Column]:
    """The four filters on a text: A under 200 words, B few distinct words, C many capitals, D a marked character."""
    w = F.array_remove(F.split(text, GAP), "")
    n = F.size(w).cast("long")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(w)).cast("long") < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def profiles(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, A to E, docs, good, toxic: the documents counted by part and failures.

    E fails a document whose text (null: empty) a smaller id has anywhere; texts with equal MD5 count as equal. Rows
    with a null id have no smaller id and are none, so they never fail E; repeated rows of one id don't fail each
    other. A null part counts as the empty string. A document is good or toxic if any label of its id says so.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    flags = ["A", "B", "C", "D"]
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.md5(t.cast("binary")).alias("h"), *[c.alias(k) for k, c in failures(t).items()])
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    known = rows.where("id is not null").join(marks, "id", "left").select(*rows.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # rows without an id have no label; in the join they would all meet in one task
    every = known.unionByName(rows.where("id is null").withColumns({"good": no, "toxic": no}))
    same = ["h", "part", "good", "toxic", *flags]
    one = every.groupBy("id", *same).agg(F.count("*").alias("k"))
    texts = one.groupBy(*same).agg(F.sum("k").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k"))).alias("m"), F.sum(F.when(F.col("id").isNull(), F.col("k")).otherwise(0)).alias("anonymous"))
    # a text has at most four rows for each part here, however many documents hold it
    first = F.min("m.id").over(Window.partitionBy("h"))
    texts = texts.withColumn("firsts", F.coalesce(F.when(F.col("m.id") == first, F.col("m.k")), F.lit(0)) + F.col("anonymous"))
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("firsts").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("firsts")).alias("n"))))
    out = texts.select("part", *flags, "good", "toxic", split.alias("x")).select("part", *flags, "x.E", "x.n", "good", "toxic").where("n > 0")
    return out.groupBy("part", *flags, "E").agg(F.sum("n").alias("docs"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def survivors(found: DataFrame, filters: str) -> DataFrame:
    """part, subset (bit i: the i-th filter is applied), docs, good, toxic that pass all filters of the subset; no row where none do."""
    k = len(filters)
    cube = found.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("gid"))
    passed = F.lit(True)
    for f in filters:
        passed = passed & ~F.coalesce(F.col(f), F.lit(False))  # null: not selected
    # the part's bit of the grouping id is the highest, a set bit means: summed over
    subset = sum((F.when(F.col("gid").bitwiseAND(1 << (k - 1 - i)) == 0, 1 << i).otherwise(0) for i in range(k)), F.lit(0))
    return cube.where((F.col("gid") < (1 << k)) & passed).select("part", subset.cast("int").alias("subset"), *COUNTS)


def _table(rows: list[dict], schema: str) -> Column:
    """A fixed list as one literal, a row for each entry."""
    return F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))


def audit(found: DataFrame, filters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the filters.

    found: part, one boolean column for each filter (named by its letter, true: fails), and docs, good, toxic as
    profiles() gives them. Zeros are rows like others; without documents there are no rows.
    """
    k = len(filters)
    if not 1 <= k <= MOST:
        raise ValueError(f"1 to {MOST} filters, not {k}")
    left = cut(survivors(found, filters), "survivors")
    parts = left.where("subset = 0").select("part")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    pairs = [{"f": f, "before": s, "after": s | bit[f], "weight": factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())} for f in filters for s in range(1 << k) if not s & bit[f]]
    p = parts.select("part", _table(pairs, "f string, before int, after int, weight long").alias("x")).select("part", "x.*")
    for side in ("before", "after"):
        p = p.join(left.select("part", F.col("subset").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in COUNTS]), ["part", side], "left").na.fill(0, [f"{c}_{side}" for c in COUNTS])
    w = Window.partitionBy("part", "f")  # as many rows as subsets without the filter
    p = p.withColumns({"kept": F.col("docs_after"), "removed": F.col("docs_before") - F.col("docs_after"), "good_lost": F.col("good_before") - F.col("good_after"), "toxic_lost": F.col("toxic_before") - F.col("toxic_after")})
    most = F.expr("bit_count(before)") == k - 1
    p = p.withColumns({"fails": F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(w), "unique_fails": F.sum(F.when(most, F.col("removed"))).over(w), "shapley": F.sum(F.col("weight") * F.col("removed")).over(w)})
    steps = [{"filter_order": "".join(o), "step": i + 1, "f": f, "before": sum(bit[x] for x in o[:i])} for o in permutations(filters) for i, f in enumerate(o)]
    out = parts.select("part", _table(steps, "filter_order string, step int, f string, before int").alias("x")).select("part", "x.*").join(p, ["part", "f", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS low, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(s.doc_id > low, false)} AS bad FROM s LEFT JOIN m ON s.doc_id = m.doc_id),
f AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY part, bad),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT [a.c, b.c, x.c, y.c, z.c] AS o FROM l a JOIN l b ON a.c <> b.c JOIN l x ON x.c NOT IN (a.c, b.c) JOIN l y ON y.c NOT IN (a.c, b.c, x.c) JOIN l z ON z.c NOT IN (a.c, b.c, x.c, y.c)),
p AS (SELECT o, i AS step, o[i] AS c FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
e AS (SELECT part, o, step, c, n, good, toxic, bad[c] AS fails, len(list_filter(o[1:step - 1], lambda x: bad[x])) > 0 AS gone, len(list_filter(o, lambda x: bad[x])) AS n_bad FROM f, p),
r AS (SELECT part, array_to_string(o, '') AS filter_order, step, c,
  sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND n_bad = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM e GROUP BY part, o, step, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r
"""
