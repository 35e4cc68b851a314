"""Forty shards: near-equal sizes whatever the partitions, slots, sizes and groups against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from pulseframe.llm import sharding

SHARDS = 40


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "w" * rng.randint(1, 9)
    texts = [" ".join(word() for _ in range(rng.choice([9, 30, 90]))) for _ in range(4000)]
    texts += ["one copy of many " * 5] * 900 + ["pair"] * 2 + [None, None, ""]
    mean = sum(len(t or "") + 16 for t in texts) / SHARDS
    texts += [" ".join(word() for _ in range(int(0.6 * mean / 6)))]  # one row that fills over half a shard
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(None, "no id"), (None, "no id"), (5, "of five again")]


def check(rows, got):
    size = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(size)
    at = defaultdict(list)
    for r in got:
        at[r.shard].append(r)
    assert set(at) == set(range(SHARDS)) and all(sorted(r.slot for r in p) == list(range(len(p))) for p in at.values())
    mean = sum(s for _, s, _ in size) / SHARDS
    b = [sum(r.size for r in p) for p in at.values()]
    n = [len(p) for p in at.values()]
    assert max(b) <= 1.02 * mean and min(b) >= 0.98 * mean, (max(b) / mean, min(b) / mean)
    assert max(n) <= 1.1 * len(rows) / SHARDS, max(n) * SHARDS / len(rows)
    of = defaultdict(set)
    for r in got:
        of[r.text_crc32].add(r.shard)
    whole = {zlib.crc32((t or "").encode()) for _, t in rows} - {zlib.crc32(("one copy of many " * 5).encode()), 0}  # null and empty texts have one checksum
    assert all(len(of[c]) == 1 for c in whole) and len(of[zlib.crc32(("one copy of many " * 5).encode())]) > 3


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_balance_does_not_depend_on_partitions(spark, rows, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SHARDS).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_balance_of_many_packing_tasks(spark, rows, monkeypatch):
    """Small groups in some ninety tasks with few bins each."""
    monkeypatch.setattr(sharding, "GROUPS_MB", 0.002)
    monkeypatch.setattr(sharding, "input_bytes", lambda df: 190_000)
    monkeypatch.setattr(sharding, "BINS", 64)
    check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), SHARDS).collect())
