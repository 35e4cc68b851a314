"""Pages through the data sources: complete or an error, short pages, cursors that move on between runs."""

import json

import pytest

from pulseframe.sources import paged


@pytest.fixture
def folder(tmp_path):
    def put(number, items, count=None, **more):
        (tmp_path / f"page={number}").mkdir(exist_ok=True)
        (tmp_path / f"page={number}" / "a.txt").write_text(json.dumps({"items": items} | ({"page_count": count} if count is not None else {}) | more))

    put.root = f"file://{tmp_path}"
    return put


def load(spark, folder, **options):
    paged.register(spark)
    r = spark.read.format("paged").option("client", "pulseframe.sources.paged:FolderPages").option("root", folder.root)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_numbered_pages_are_complete_or_an_error(spark, folder):
    for k in range(1, 8):
        folder(k, [k] * k, 7)
    df = load(spark, folder)
    assert df.rdd.getNumPartitions() == 7
    assert sorted((r.page, r.items, json.loads(r.raw)["items"]) for r in df.collect()) == [(k, k, [k] * k) for k in range(1, 8)]
    folder(4, [4], 8)
    with pytest.raises(Exception, match="page 4 tells of 8 pages"):
        load(spark, folder).collect()
    folder(4, [4], 7, page=5)
    with pytest.raises(Exception, match="page 5 came for page 4"):
        load(spark, folder).collect()
    for k in range(1, 8):
        folder(k, [k], 9)
    with pytest.raises(Exception, match="page [89] is missing"):
        load(spark, folder).collect()
    with pytest.raises(Exception, match="9 pages, more than 5"):
        load(spark, folder, most=5).collect()


def test_short_pages_end_a_read(spark, folder):
    for k in range(1, 12):
        folder(k, [k] * (3 if k < 9 else 2 if k == 9 else 0))
    df = load(spark, folder, size=3, stride=2)
    assert df.rdd.getNumPartitions() == 2 and sorted((r.page, r.items) for r in df.collect()) == [(k, 3) for k in range(1, 9)] + [(9, 2)]
    with pytest.raises(Exception, match="more than 6 pages"):
        load(spark, folder, size=3, stride=2, most=6).collect()
    with pytest.raises(Exception, match="need the option size"):
        load(spark, folder).collect()
    folder(1, [])
    assert load(spark, folder, size=3, stride=1).count() == 0


def test_a_cursor_goes_on_where_it_was(spark, folder, tmp_path):
    paged.register(spark)

    def run():
        s = spark.readStream.format("paged_cursor").option("client", "pulseframe.sources.paged:FolderPages").option("root", folder.root).option("batch_pages", 3).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.page, r.cursor, r.items) for r in spark.read.schema(paged.SCHEMA).parquet(str(tmp_path / "out")).collect())

    for k in range(1, 8):
        folder(k, [k] * (k % 3), 7)
    want = [(k, str(k), k % 3) for k in range(1, 8) if k % 3]
    assert run() == want
    assert run() == want  # nothing new, nothing twice
    folder(7, [7], 9)
    folder(8, [8], 9)
    folder(9, [9], 9)
    assert run() == want + [(8, "8", 1), (9, "9", 1)]


def test_a_batch_that_changed_is_an_error(folder):
    for k in range(1, 4):
        folder(k, [k], 3)
    r = paged.CursorReader({"client": "pulseframe.sources.paged:FolderPages", "root": folder.root, "batch_pages": "2"})
    rows, at = r.read(r.initialOffset())
    assert at == {"cursor": "2", "page": 2} and list(r.readBetweenOffsets(r.initialOffset(), at)) == list(rows)
    with pytest.raises(paged.IncompleteFetch):
        r.readBetweenOffsets(r.initialOffset(), {"cursor": "x", "page": 2})


def bundles(tmp_path, count, size, skip=()):
    for k in range(-(-count // size)):
        (tmp_path / f"pages={k}").mkdir()
        lines = [json.dumps({"page": n, "page_count": count, "items": [n] * (n % 3)}) for n in range(k * size + 1, min(count, (k + 1) * size) + 1) if n not in skip]
        (tmp_path / f"pages={k}" / "a.txt").write_text("\n".join(lines) + "\n")


def test_many_pages_need_few_tasks_and_files(spark, folder, tmp_path):
    bundles(tmp_path, 1000, 64)
    df = load(spark, folder, bundle=64, most=2000, tasks=16)
    assert df.rdd.getNumPartitions() == 16 and sorted((r.page, r.items) for r in df.collect()) == [(n, n % 3) for n in range(1, 1001)]
    (tmp_path / "pages=15" / "b.txt").write_text(json.dumps({"page": 1000, "page_count": 1000, "items": []}))
    with pytest.raises(Exception, match="page 1000 comes twice"):
        load(spark, folder, bundle=64, most=2000).collect()


def test_a_bundle_without_a_page_is_an_error(spark, folder, tmp_path):
    bundles(tmp_path, 300, 64, skip=(200,))
    with pytest.raises(Exception, match="page 200 is missing"):
        load(spark, folder, bundle=64).collect()
    r = paged.AheadReader({"client": "pulseframe.sources.paged:FolderPages", "root": folder.root, "bundle": "64", "batch_pages": "40", "tasks": "128"})
    with pytest.raises(paged.IncompleteFetch, match="after 199 is missing"):
        [row for p in r.partitions(r.initialOffset(), r.latestOffset()) for row in r.read(p)]


def test_a_batch_is_requested_by_many_tasks(spark, folder, tmp_path):
    bundles(tmp_path, 1000, 64)
    paged.register(spark)
    s = spark.readStream.format("paged_cursor").option("client", "pulseframe.sources.paged:FolderPages").option("root", folder.root).option("bundle", 64).option("batch_pages", 40).option("tasks", 10).load()
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [p.numInputRows for p in q.recentProgress if p.numInputRows] == [267, 267, 133]
    finally:
        q.stop()
    rows = spark.read.schema(paged.SCHEMA).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.page, r.cursor, r.items) for r in rows) == [(n, str(n), n % 3) for n in range(1, 1001) if n % 3]


def test_a_long_backlog_needs_few_batches_and_tasks(spark, folder, tmp_path):
    bundles(tmp_path, 1000, 10)
    r = paged.AheadReader({"client": "pulseframe.sources.paged:FolderPages", "root": folder.root, "bundle": "10", "batch_pages": "200", "tasks": "8"})
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    # evenly and in whole bundles, not the most pages in each of a few tasks
    assert [p.pages for p in parts] == [130] * 7 + [90]
    assert [row[0] for p in parts for row in r.read(p)] == [n for n in range(1, 1001) if n % 3]
    again = paged.AheadReader(r.options)  # as after a failure: without what the first reader was told
    assert [(p.cursor, p.pages, p.end) for p in again.partitions(r.initialOffset(), {"cursor": "1000", "page": 1000})] == [(p.cursor, p.pages, p.end) for p in parts]
    r.at = {"cursor": "1000", "page": 1000}
    assert r.latestOffset() == r.at and r.partitions(r.at, r.at) == []
