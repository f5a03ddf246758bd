"""Paged remote sources as a Python data source; the fetcher is given by the caller, offline by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: name -> fetch(offset, length) -> list of (id, text); registered by the application.
FETCHERS: dict[str, Callable[[int, int], list[tuple[str, str]]]] = {"offline": lambda offset, length: []}


class Page(InputPartition):
    def __init__(self, offset: int, length: int) -> None:
        self.offset, self.length = offset, length


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.fetch, self.total, self.page = FETCHERS[options.get("fetcher", "offline")], int(options.get("rows", "0")), int(options.get("page", "100"))

    def partitions(self) -> list[InputPartition]:
        return [Page(o, min(self.page, self.total - o)) for o in range(0, self.total, self.page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch(partition.offset, partition.length)


class PagedSource(DataSource):
    """``spark.read.format("paged").option("fetcher", name).option("rows", n)``: one partition a page."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "doc_id string, text string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
