"""A paged remote source as a Spark data source: one task per page, rows as JSON text.

Options: `pages` names a folder that holds page files (one JSON list each) and stands for the service; `since` skips items
that are older. A real connector replaces fetch().
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(folder: str, page: str) -> list[dict]:
    """The items of one page: a list, or one item on each line."""
    text = Path(folder, page).read_text()
    return json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.since = options["pages"].removeprefix("file://").removeprefix("file:"), options.get("since")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.name) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for item in fetch(self.folder, partition.value):
            if self.since is None or (item.get("updated") or "") >= self.since:
                yield item.get("id"), item.get("updated"), json.dumps(item, sort_keys=True)


class PagedSource(DataSource):
    """format("paged_items")"""

    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def schema(self) -> str:
        return "id string, updated string, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
