"""A paged index as a Python data source: pages are shared out among partitions, each of which stops at a short page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(InputPartition):
    """Every step-th page from the first on."""

    def __init__(self, first: int, step: int):
        super().__init__(first)
        self.first, self.step = first, step


def register(spark: SparkSession, name: str, schema: str, page_rows: int, fetch: Callable[[int], list[tuple]], partitions: int = 4) -> None:
    """Make spark.read.format(name) read pages 0, 1, ... by fetch(number) on executors, until they end.

    fetch must be picklable. A page of fewer than page_rows rows is the last one; each partition asks for
    its share of the pages and stops at the first short one, which is at most one more request each.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[Pages]:
            return [Pages(i, partitions) for i in range(partitions)]

        def read(self, partition: Pages) -> Iterator[tuple]:
            number = partition.first
            while True:
                rows = fetch(number)
                yield from rows
                if len(rows) < page_rows:
                    return
                number += partition.step

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader()

    spark.dataSource.register(Source)
