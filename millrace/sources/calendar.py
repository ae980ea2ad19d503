"""A connector: days of a span as a table, a partition for each month's worth of them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 31


class Span(InputPartition):
    def __init__(self, first: date, days: int):
        super().__init__(None)
        self.first, self.days = first, days


class Days(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.first, self.days = date.fromisoformat(options["start"]), int(options["days"])

    def partitions(self) -> list[InputPartition]:
        return [Span(self.first + timedelta(k), min(STEP, self.days - k)) for k in range(0, self.days, STEP)] or [Span(self.first, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k in range(partition.days):
            day = partition.first + timedelta(k)
            yield day, day.isoweekday(), day.isocalendar()[1]


class Calendar(DataSource):
    """Options: start (ISO date), days (0 or more). Columns: day, weekday (1 is Monday), week (ISO)."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, weekday int, week int"

    def reader(self, schema) -> Days:  # noqa: ANN001
        return Days(self.options)
