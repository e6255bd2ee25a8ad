"""A listing that is read page by page, as a Python data source: each listing's pages are asked for in turn until the
stop rule holds, listings side by side.

A listing ends with the page at which the pages in a row without anything new count `most`: a page without cards
counts twice, as one without cards and as one without new cards. Filters on the listing reach the source, which then
asks for no page of any other listing; on a session with spark.sql.python.filterPushdown.enabled, that is.

Defined results: a listing without pages gives no rows; listings that are named twice are read once; a card that
comes twice is a row each time; a null card is a row with a null card; a page that fails is asked for again, and after
`retries` failures the task fails, so that no page is left out in silence.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: The card, and whether it is new to the one who asks.
Card = tuple[str | None, bool]
FetchPage = Callable[[str, int], Sequence[Card]]


class Listings(InputPartition):
    """Listings that one task reads."""

    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


class PagedReader(DataSourceReader):
    def __init__(self, fetch: FetchPage, options: dict) -> None:
        self.fetch = fetch
        self.names = sorted(set(json.loads(options["listings"])))
        self.most, self.retries, self.tasks = (int(options.get(k, v)) for k, v in (("most", 3), ("retries", 3), ("tasks", 64)))
        self.delay = float(options.get("delay", 1.0))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("listing",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = [x for x in self.names if x in wanted]
            else:
                yield f

    def partitions(self) -> Sequence[Listings]:
        return [Listings(self.names[k :: self.tasks]) for k in range(min(self.tasks, len(self.names)))] or [Listings([])]

    def page(self, listing: str, page: int) -> Sequence[Card]:
        for attempt in range(1, self.retries + 1):
            try:
                return self.fetch(listing, page)
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.delay * attempt)
        raise ValueError("retries must be 1 or more")

    def read(self, partition: Listings) -> Iterator[tuple]:
        for listing in partition.names:
            page, streak = 0, 0
            while streak < self.most:
                cards = self.page(listing, page)
                for card, new in cards:
                    yield listing, page, card, new
                streak = 0 if any(new for _, new in cards) else streak + (1 if cards else 2)
                page += 1


def paged_source(fetch: FetchPage, name: str = "paged_listing") -> type[DataSource]:
    """The source of listings whose pages a function gives: the cards of a page of a listing, from page 0; none beyond its end."""

    class PagedListing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "listing string, page int, card string, new boolean"

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, dict(self.options))

    return PagedListing


def paged_listing(spark: SparkSession, listings: Sequence[str], fetch: FetchPage, most: int = 3, retries: int = 3, delay: float = 1.0, tasks: int = 64, name: str = "paged_listing") -> DataFrame:
    """listing, page, card, new: the cards of all pages up to each listing's end."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged_source(fetch, name))
    options = {"listings": json.dumps(list(listings)), "most": most, "retries": retries, "delay": delay, "tasks": tasks}
    return spark.read.format(name).options(**options).load()


def captured_pages(folder: str) -> FetchPage:
    """Pages that were captured below a folder that all executors see, a page a folder of JSON lines {card, new}:
    listing=NAME/page=N. A folder that the executor doesn't see is an error, not a listing without pages."""

    def fetch(listing: str, page: int) -> list[Card]:
        root = Path(folder.removeprefix("file://"))
        if not root.is_dir():
            raise FileNotFoundError(f"captured pages must be in a folder that executors can open: {folder}")
        where = root / f"listing={quote(listing, safe=' -')}" / f"page={page}"
        rows = [json.loads(line) for f in sorted(where.glob("part-*")) for line in f.read_text().splitlines()]
        return [(r.get("card"), r["new"]) for r in rows]

    return fetch
