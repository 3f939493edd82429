"""Paginated catalogue scans and polite fetches with injected fetchers (SRC-1, SRC-7 to SRC-13)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(DataSource):
    """``spark.read.format("catalogue_pages")``: one partition per page of a catalogue.

    Options: ``total`` and ``page_size`` (records), ``fetcher`` (``module:function`` that
    takes a page number from 0 and a size and returns records as dicts), ``delay`` in
    seconds between pages of a task, ``retries``.
    """

    @classmethod
    def name(cls) -> str:
        return "catalogue_pages"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.total, self.size = int(options["total"]), int(options.get("page_size", 25))
        self.fetcher, self.delay, self.retries = options["fetcher"], float(options.get("delay", 0)), int(options.get("retries", 5))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(-(-self.total // self.size))]

    def read(self, partition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        for attempt in range(self.retries):
            try:
                records = fetch(partition.value, self.size)
                break
            except OSError:
                if attempt == self.retries - 1:
                    raise
                time.sleep(self.delay * 2**attempt)
        time.sleep(self.delay)
        for r in records:
            yield partition.value, json.dumps(r)


def fetched(keys: DataFrame, fetch: Callable[[str], str | None], *, key_col: str = "key", delay: float = 0.5, parallel: int = 4) -> DataFrame:
    """``keys`` with ``response``: what an injected fetcher gives, null where it fails.

    At most ``parallel`` tasks ask at a time and each waits between calls.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema) + ", response string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key in frame[key_col]:
                try:
                    out.append(fetch(key))
                except Exception:  # noqa: BLE001 - a failed lookup is a miss
                    out.append(None)
                time.sleep(delay)
            yield frame.assign(response=out)

    return keys.repartition(parallel).mapInPandas(run, schema)


def pdf_body(body: bytes, least: int = 2000) -> bool:
    """Whether a body is a PDF: long enough, its mark among the first 20 bytes."""
    return len(body) > least and b"%PDF" in body[:20]


def downloads(wanted: DataFrame, present: DataFrame, fetch: Callable[[str], tuple[int, bytes]], *, delay: float = 3.0, parallel: int = 2, beyond: int = 0, accept: Callable[[bytes], bool] = len) -> DataFrame:
    """Blobs of ids that are not present: ``safe, url, content, ok``; only status 200 with an accepted body is ok.

    Files of ``beyond`` bytes or fewer do not count as present. For PDFs this is 2000, and
    ``accept`` is :func:`pdf_body`.
    """
    schema = "safe string, url string, content binary, ok boolean"
    todo = wanted.select("safe", "url").join(present.filter(F.col("length") > beyond).select("safe"), "safe", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for safe, url in zip(frame["safe"], frame["url"]):
                try:
                    status, body = fetch(url)
                except Exception:  # noqa: BLE001 - reported as not ok
                    status, body = 0, b""
                good = status == 200 and bool(accept(body))
                rows.append((safe, url, body if good else None, good))
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=["safe", "url", "content", "ok"])

    return todo.repartition(parallel).mapInPandas(run, schema)


def open_access_url(response: F.Column) -> F.Column:
    """First open-access PDF of a lookup by DOI or of a title search, as JSON text."""
    one = F.get_json_object(response, "$.openAccessPdf.url")
    listed = F.from_json(F.get_json_object(response, "$.data"), "array<struct<openAccessPdf: struct<url: string>>>")
    return F.coalesce(one, F.get(F.filter(F.transform(listed, lambda p: p["openAccessPdf"]["url"]), lambda u: u.isNotNull()), F.lit(0)))


def best_location_url(response: F.Column) -> F.Column:
    return F.get_json_object(response, "$.best_oa_location.url_for_pdf")
