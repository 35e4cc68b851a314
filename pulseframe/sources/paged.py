"""Vendor pages as Spark data sources: pages are requested by the tasks, and a cursor is the offset of a stream.

`register(spark)` adds two formats. Both take the option `client`, "package.module:factory"; the factory gets the other
options as a dictionary, in each task, and returns an object with

* page(number) -> dict(raw, items, page_count or None), for the format `paged`: a partition for each page where the
  first page tells how many there are, and runs of pages in `tasks` partitions where there are more; else `stride`
  partitions that each take every stride-th page up to one shorter than `size`. An absent, repeated or short page, or
  another count than at first, fails the read: no silent gap.
* after(cursor or None) -> dict(raw, items, cursor, more), for the format `paged_cursor`, a stream: a micro-batch ends
  after `batch_pages` pages, a batch that is read again stops at the same cursor, and only its cursor is remembered.
* ahead(cursor or None, pages) -> the cursors of so many next pages, if the source can tell them without their contents
  (numbers, an index): a micro-batch then takes up to `batch_pages` pages in each of `tasks` tasks, dealt evenly in whole
  bundles, and the tasks request them. Each task has a start of its own, so a long backlog goes faster with more pages a task.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from ..session import ship

SCHEMA = "page int, cursor string, items int, raw string"
MOST = 500  # pages of one read, unless the option says more
TASKS = 200  # partitions of one read


class IncompleteFetch(RuntimeError):
    """Pages are missing, or changed while they were read."""


def client_of(options: dict):
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class Pages(InputPartition):
    """The pages from first on: up to last where their count is known, else every step-th."""

    def __init__(self, first: int, last: int | None, step: int, count: int | None):
        super().__init__((first, last, step, count))
        self.first, self.last, self.step, self.count = first, last, step, count


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.first, self.most = int(options.get("first", 1)), int(options.get("most", MOST))
        self.size, self.stride = int(options.get("size", 0)), int(options.get("stride", 8))
        self.tasks = int(options.get("tasks", TASKS))

    def partitions(self) -> list[Pages]:
        count = client_of(self.options).page(self.first)["page_count"]
        if count is None:
            if self.size < 1:
                raise ValueError("pages without a count need the option size")
            return [Pages(self.first + k, None, self.stride, None) for k in range(self.stride)]
        if count > self.most:
            raise IncompleteFetch(f"{count} pages, more than {self.most}")
        # an empty result has no page or one
        count_read = max(count, 1)
        n = min(count_read, self.tasks)
        ends = [self.first + count_read * k // n for k in range(n + 1)]
        return [Pages(a, b - 1, 1, count) for a, b in zip(ends, ends[1:])]

    def read(self, part: Pages) -> Iterator[tuple]:
        client, number, short = client_of(self.options), part.first, False
        while number < self.first + self.most:
            got = client.page(number)
            if got is None:
                raise IncompleteFetch(f"page {number} is missing")
            if got["page_count"] != part.count:
                raise IncompleteFetch(f"page {number} tells of {got['page_count']} pages, the first one of {part.count}")
            if got.get("page", number) != number:
                raise IncompleteFetch(f"page {got['page']} came for page {number}")
            if got["items"] or part.count:
                yield number, None, got["items"], got["raw"]
            short = got["items"] < self.size
            if number == part.last or part.count is None and short:
                return
            number += part.step
        raise IncompleteFetch(f"more than {self.most} pages")


class CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.pages, self.client = options, int(options.get("batch_pages", 50)), None

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("start"), "page": 0}

    def _from(self, start: dict, last: int):
        """(rows, offset) of the pages after start, up to page `last`."""
        self.client = self.client or client_of(self.options)
        rows, at, more = [], start, True
        while more and at["page"] < last:
            got = self.client.after(at["cursor"])
            more = got["more"]
            if got["cursor"] == at["cursor"]:  # nothing new
                if more:
                    raise IncompleteFetch(f"the cursor {at['cursor']} doesn't move")
                break
            at = {"cursor": got["cursor"], "page": at["page"] + 1}
            if got["items"]:
                rows.append((at["page"], got["cursor"], got["items"], got["raw"]))
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self._from(start, start["page"] + self.pages)
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, at = self._from(start, end["page"])
        if at != end:
            raise IncompleteFetch(f"a batch that ended at {end} now ends at {at}")
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class Walk(InputPartition):
    """So many pages after a cursor, whose last has the cursor `end`."""

    def __init__(self, cursor: str | None, page: int, pages: int, end: str):
        super().__init__((cursor, page, pages, end))
        self.cursor, self.page, self.pages, self.end = cursor, page, pages, end


class AheadReader(DataSourceStreamReader):
    """Pages of a client that tells its cursors ahead: the driver has cursors only, the tasks request the pages."""

    def __init__(self, options: dict):
        self.options, self.pages, self.tasks = options, int(options.get("batch_pages", 50)), int(options.get("tasks", 1))
        self.bundle, self.at, self.told = max(1, int(options.get("bundle", 0))), None, (None, [])

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("start"), "page": 0}

    def latestOffset(self) -> dict:
        # a query that goes on names its offset by partitions() first
        at = self.at or self.initialOffset()
        # anew each time, as pages may have come
        found = client_of(self.options).ahead(at["cursor"], self.pages * self.tasks)
        self.told = (at["cursor"], found)
        return {"cursor": found[-1], "page": at["page"] + len(found)} if found else at

    def partitions(self, start: dict, end: dict) -> list[Walk]:
        self.at = end
        n = end["page"] - start["page"]
        if n < 1:
            return []
        told, found = self.told
        if told != start["cursor"] or len(found) != n:  # a batch that is planned again
            found = client_of(self.options).ahead(start["cursor"], n)
        if len(found) < n or found[-1] != end["cursor"]:
            raise IncompleteFetch(f"a batch that ended at {end} now ends at {found[-1:]} after {len(found)} pages")
        each = min(self.pages, -(-n // (self.tasks * self.bundle)) * self.bundle)
        return [Walk(found[k - 1] if k else start["cursor"], start["page"] + k, min(each, n - k), found[min(k + each, n) - 1]) for k in range(0, n, each)]

    def read(self, part: Walk) -> Iterator[tuple]:
        client, cursor = client_of(self.options), part.cursor
        for k in range(1, part.pages + 1):
            got = client.after(cursor)
            if got["cursor"] == cursor:
                raise IncompleteFetch(f"the page after {cursor} is missing")
            cursor = got["cursor"]
            if got["items"]:
                yield part.page + k, cursor, got["items"], got["raw"]
        if cursor != part.end:
            raise IncompleteFetch(f"pages that ended at {part.end} now end at {cursor}")


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


class PagedCursor(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_cursor"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> AheadReader:
        if not hasattr(client_of(dict(self.options)), "ahead"):
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "ahead"})  # then Spark takes the simple reader
        return AheadReader(dict(self.options))

    def simpleStreamReader(self, schema) -> CursorReader:
        return CursorReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Paged)
    spark.dataSource.register(PagedCursor)


class FolderPages:
    """A client of pages that lie as text files in folders of a shared file system (option `root`): captured answers, replays.

    A page is JSON with `items`, and with `page_count` unless the source gives none. Each has a folder page=N; with the
    option `bundle`, so many pages lie as lines in a folder pages=K, K = (N - 1) // bundle, and tell their number as
    `page`. A cursor is a page's number.
    """

    def __init__(self, options: dict):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(options["root"])
        self.bundle, self.held = int(options.get("bundle", 0)), (None, {})

    def _files(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.path for f in found if f.size and not f.base_name.startswith((".", "_")))

    def _folder(self, number: int) -> str:
        return f"pages={(number - 1) // self.bundle}" if self.bundle else f"page={number}"

    def _pages(self, folder: str) -> dict[int, tuple[str, dict]]:
        """The pages of a bundle, text and content, by number; the last bundle is held."""
        if self.held[0] != folder:
            pages = {}
            for path in self._files(folder):
                with self.fs.open_input_file(path) as f:
                    for line in f.read().decode().split("\n"):
                        if line.strip():
                            got = json.loads(line)
                            if got["page"] in pages:
                                raise IncompleteFetch(f"page {got['page']} comes twice")
                            pages[got["page"]] = (line, got)
            self.held = (folder, pages)
        return self.held[1]

    def _page(self, number: int) -> tuple[str | None, dict | None]:
        if self.bundle:
            return self._pages(self._folder(number)).get(number, (None, None))
        found = self._files(self._folder(number))
        if not found:
            return None, None
        with self.fs.open_input_file(found[0]) as f:
            text = f.read().decode()
        return text, json.loads(text)

    def page(self, number: int) -> dict | None:
        text, got = self._page(number)
        if got is None:
            return None
        return {"raw": text, "items": len(got["items"]), "page_count": got.get("page_count"), "page": got.get("page", number)}

    def after(self, cursor: str | None) -> dict:
        number = int(cursor or 0) + 1
        text, got = self._page(number)
        if got is None:
            return {"raw": None, "items": 0, "cursor": cursor, "more": False}
        return {"raw": text, "items": len(got["items"]), "cursor": str(number), "more": number < got["page_count"]}

    def ahead(self, cursor: str | None, pages: int) -> list[str]:
        """Up to the count that the next page tells, as far as their folders are there."""
        number, found, seen = int(cursor or 0), [], None
        got = self.page(number + 1)
        last = number + pages
        if got is not None and got["page_count"] is not None:
            last = min(last, max(got["page_count"], number + 1))
        while got is not None and number < last:
            number += 1
            if (folder := self._folder(number)) != seen and not self._files(folder):
                break
            seen = folder
            found.append(str(number))
        return found
