"""Services that answer page by page, as a source of tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGES = 16  # pages that a task asks for


class Pages(InputPartition):
    """Pages from ``first`` on, before ``last``."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def paged_source(name: str, schema: str, count: Callable[[], int], fetch: Callable[[int], list[dict]], pages: int = PAGES, attempts: int = 3) -> type[DataSource]:
    """A source called ``name``, to be registered with ``spark.dataSource``; ``fetch`` gives the records of a page.

    Tasks ask for ``pages`` pages each. A stream remembers how many pages it has read, so it reads each page once, those
    that came meanwhile in the next batch. A page that fails is asked for ``attempts`` times; then the task fails, which
    Spark repeats elsewhere. Fields that a record lacks are null; others than the schema's are ignored.
    """

    def ranges(first: int, last: int) -> list[Pages]:
        return [Pages(at, min(at + pages, last)) for at in range(first, last, pages)]

    def records(page: int) -> list[dict]:
        for left in reversed(range(attempts)):
            try:
                return fetch(page)
            except OSError:
                if not left:
                    raise
        return []

    def rows(part: Pages, columns: list[str]) -> Iterator[tuple]:
        for page in range(part.first, part.last):
            for record in records(page):
                yield tuple(record.get(c) for c in columns)

    class Reader(DataSourceReader):
        def __init__(self, columns: list[str]) -> None:
            self.columns = columns

        def partitions(self) -> list[Pages]:
            return ranges(0, count())

        def read(self, partition: Pages) -> Iterator[tuple]:
            return rows(partition, self.columns)

    class Stream(DataSourceStreamReader):
        def __init__(self, columns: list[str]) -> None:
            self.columns = columns

        def initialOffset(self) -> dict:
            return {"pages": 0}

        def latestOffset(self) -> dict:
            return {"pages": count()}

        def partitions(self, start: dict, end: dict) -> list[Pages]:
            return ranges(start["pages"], end["pages"])

        def read(self, partition: Pages) -> Iterator[tuple]:
            return rows(partition, self.columns)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader(schema.names)

        def streamReader(self, schema) -> Stream:
            return Stream(schema.names)

    return Source
