"""A Python data source: ``spark.read.format("slots")`` makes low-discrepancy target points in parallel."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PRIMES = (2, 3, 5, 7, 11, 13)


class _Span(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.n, self.dims, self.parts = int(options.get("n", 16)), int(options.get("dims", 3)), int(options.get("partitions", 4))

    def partitions(self):
        step = max(1, -(-self.n // self.parts))
        return [_Span(i, min(i + step, self.n + 1)) for i in range(1, self.n + 1, step)]

    def read(self, span):
        for i in range(span.low, span.high):
            out = []
            for base in PRIMES[: self.dims]:
                x, f, k = 0.0, 1.0, i
                while k:
                    f /= base
                    x += f * (k % base)
                    k //= base
                out.append(x)
            yield (f"slot_{i:06d}", out)


class SlotSource(DataSource):
    """Options ``n``, ``dims`` and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "slots"

    def schema(self) -> str:
        return "slot_id string, point array<double>"

    def reader(self, schema):
        return _Reader(self.options)
