"""Plug-in fetchers as a Spark data source.

A fetcher says what it has (``symbols`` with their years) and fetches the bars of
one symbol and range of days as Arrow batches; :func:`register_fetcher` makes it a
data source that Spark reads partition by partition, one per symbol and year. Symbols
and days are chosen by the reader options ``symbols``, ``start`` and ``end``, or by pushed
filters, and partitions outside are never planned, so nothing of them is fetched. Every
batch passes the fetcher's ``validate`` step before Spark sees it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    LessThan, LessThanOrEqual)

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
_ARROW = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "volume")]])


class BarFetcher:
    """What a plug-in implements. Instances are sent to the executors."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def symbols(self) -> Iterable[tuple[str, int]]:
        """``(symbol, year)`` pairs that have bars."""
        raise NotImplementedError

    def fetch(self, symbol: str, start: dt.date, end: dt.date) -> Iterator[pa.RecordBatch]:
        """Bars of ``symbol`` with ``start <= date < end``."""
        raise NotImplementedError

    def validate(self, batch: pa.RecordBatch, symbol: str, start: dt.date, end: dt.date) -> pa.RecordBatch:
        """The batch in the bars' schema. Missing columns and bars of another symbol or day are
        errors; NaN becomes NULL."""
        lacking = [f.name for f in _ARROW if f.name not in batch.schema.names]
        if lacking:
            raise ValueError(f"bars of {symbol} lack {', '.join(lacking)}")
        table = pa.Table.from_batches([batch]).select(_ARROW.names).cast(_ARROW)
        days, names = table.column("date"), table.column("symbol")
        outside = pc.or_(pc.less(days, pa.scalar(start)), pc.greater_equal(days, pa.scalar(end)))
        if pc.any(pc.fill_null(pc.or_(outside, pc.not_equal(names, symbol)), True)).as_py():
            raise ValueError(f"bars asked for {symbol} from {start} to {end}, but others came")
        columns = [pc.if_else(pc.is_nan(c), None, c) if pa.types.is_floating(c.type) else c for c in table.columns]
        return pa.Table.from_arrays(columns, schema=_ARROW).combine_chunks().to_batches()[0] if table.num_rows else batch.slice(0, 0)


class SilverFetcher(BarFetcher):
    """Bars from a folder of Parquet files partitioned by symbol (option ``path``)."""

    def _dataset(self, symbol: str | None = None) -> pads.Dataset:
        path = self.options["path"]
        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        part = pads.partitioning(pa.schema([("symbol", pa.string())]), flavor="hive")
        at = root if symbol is None else f"{root}/symbol={symbol}"
        return pads.dataset(at, filesystem=fs, format="parquet", partitioning=part, partition_base_dir=root)

    def symbols(self) -> Iterable[tuple[str, int]]:
        # File statistics tell the range of days; no rows are read.
        found: set[tuple[str, int]] = set()
        for f in self._dataset().get_fragments():
            symbol = pads.get_partition_keys(f.partition_expression)["symbol"]
            for group in f.row_groups:
                days = group.statistics["date"]
                found |= {(symbol, y) for y in range(days["min"].year, days["max"].year + 1)}
        return sorted(found)

    def fetch(self, symbol: str, start: dt.date, end: dt.date) -> Iterator[pa.RecordBatch]:
        day = pc.field("date")
        yield from self._dataset(symbol).to_batches(columns=_ARROW.names, filter=(day >= start) & (day < end))


class _Years(InputPartition):
    def __init__(self, symbol: str, start: dt.date, end: dt.date):
        super().__init__((symbol, start, end))
        self.symbol, self.start, self.end = symbol, start, end


class _Reader(DataSourceReader):
    def __init__(self, fetcher: BarFetcher):
        self.fetcher = fetcher
        o = fetcher.options
        self.only = set(o["symbols"].split(",")) if o.get("symbols") else None
        self.start = dt.date.fromisoformat(o["start"]) if o.get("start") else dt.date.min
        self.end = dt.date.fromisoformat(o["end"]) if o.get("end") else dt.date.max

    def partitions(self) -> list[InputPartition]:
        out = []
        for symbol, year in self.fetcher.symbols():
            start, end = max(self.start, dt.date(year, 1, 1)), min(self.end, dt.date(year + 1, 1, 1) if year < 9999 else dt.date.max)
            if start < end and (self.only is None or symbol in self.only):
                out.append(_Years(symbol, start, end))
        return out

    def read(self, partition: _Years | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was asked for
            return
        for batch in self.fetcher.fetch(partition.symbol, partition.start, partition.end):
            if batch.num_rows:
                yield self.fetcher.validate(batch, partition.symbol, partition.start, partition.end)


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols and day bounds choose partitions; Spark applies every filter to the rows again."""
        day = dt.timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("symbol",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            elif column == ("date",):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                    self.start = max(self.start, f.value)
                elif isinstance(f, LessThan):
                    self.end = min(self.end, f.value)
                elif isinstance(f, LessThanOrEqual) and f.value < dt.date.max:
                    self.end = min(self.end, f.value + day)
            yield f


def register_fetcher(spark: SparkSession, name: str, fetcher: type[BarFetcher], pushed: bool = False) -> None:
    """Make ``fetcher`` the data source ``name`` of the session. With ``pushed`` filters on
    symbol and date choose partitions too; Spark then wants
    ``spark.sql.python.filterPushdown.enabled`` set where the source is read."""
    reader_type = _PushedReader if pushed else _Reader

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return reader_type(fetcher(dict(self.options)))

    spark.dataSource.register(Source)


def fetch_bars(spark: SparkSession, name: str, symbols: list[str] | None = None, start: dt.date | str | None = None,
               end: dt.date | str | None = None, **options: str) -> DataFrame:
    """Bars of ``symbols`` with ``start <= date < end`` from the registered source ``name``."""
    chosen = {"symbols": ",".join(symbols) if symbols is not None else None, "start": start and str(start), "end": end and str(end)}
    reader = spark.read.format(name)
    for k, v in {**chosen, **options}.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load()
