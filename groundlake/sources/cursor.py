"""A catalogue as a batch and as a stream that grows (SRC-1, SRC-8)."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Catalogue(DataSource):
    """``spark.read.format("catalogue")`` and ``spark.readStream.format("catalogue")``.

    Options: ``fetcher`` (``module:function`` that takes ``first, size, sort`` and returns
    ``{"total": n, "records": [...]}``), ``page_size`` (25), ``sort`` (what the catalogue
    calls oldest first, so that a record keeps its position), ``delay`` in seconds between
    calls of a task, ``retries`` on ``OSError``. Rows are ``position, record`` (JSON text).

    The catalogue says how many records it has; nobody else needs to. As a stream each
    batch has the positions since the last one, a page a task, and the checkpoint holds
    where it is: a stream that starts again goes on there.
    """

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "position long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Pages:
    def __init__(self, options):
        self.fetcher, self.size, self.sort = options["fetcher"], int(options.get("page_size", 25)), options.get("sort", "oldest")
        self.delay, self.retries = float(options.get("delay", 0)), int(options.get("retries", 5))

    def ask(self, first: int, size: int) -> dict:
        module, _, function = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        for attempt in range(self.retries):
            try:
                return fetch(first, size, self.sort)
            except OSError:
                if attempt == self.retries - 1:
                    raise
                time.sleep(self.delay * 2**attempt)
        raise ValueError("retries must be 1 or more")

    def pages(self, start: int, end: int) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.size, end))) for a in range(start, end, self.size)]

    def rows(self, page: InputPartition | None) -> Iterator[tuple]:
        """The records of a page; a catalogue that gives fewer at a time is asked again until it has no more."""
        if page is None:  # an empty catalogue has no page
            return
        at, end = page.value
        while at < end:
            got = self.ask(at, end - at)["records"]
            if not got:
                return
            for r in got[: end - at]:
                yield at, json.dumps(r)
                at += 1
            time.sleep(self.delay)


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.pages(0, int(self.ask(0, 1)["total"]))

    def read(self, partition) -> Iterator[tuple]:
        return self.rows(partition)


class _Stream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seen": 0}

    def latestOffset(self) -> dict:
        return {"seen": int(self.ask(0, 1)["total"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.pages(int(start["seen"]), int(end["seen"]))

    def read(self, partition) -> Iterator[tuple]:
        return self.rows(partition)
