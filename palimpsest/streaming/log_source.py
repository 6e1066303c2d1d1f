"""The event log as a data source of Spark: `spark.readStream.format("event_log").option("path", ...)`.

Offsets of the stream are global positions, and `max_events` admits so many events to a micro-batch, whatever
the size of the log's batches. Spark keeps the offsets in the query's checkpoint: after a restart it asks for
the same range again if that was not marked as done, and goes on behind it else, so each event is delivered
once to a sink that is idempotent by batch id. As a batch source it reads a range of positions.

options: path; after (start behind this position); upto (batch reads: the last position); max_events.

A range is read by one task for each Parquet file that holds some of its positions: the driver picks batches by
their manifests and files by the statistics in their footers, and a task skips row groups by theirs. Only
committed batches are seen.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from palimpsest import schema as schemas
from palimpsest.errors import Corruption, InvalidValue
from palimpsest.sources.storage import opened, ship

FORMAT = "event_log"
POSITION = "global_position"
ROWS = 10_000


@dataclass
class Slice(InputPartition):
    """Positions behind `after` up to `upto` of a file."""

    file: str
    after: int
    upto: int


class LogFiles:
    """What a range of positions lies in. Manifests and footers are immutable, so both are read once."""

    def __init__(self, path: str):
        self.store, self.path = opened(path.rstrip("/"))
        self.manifests: list[dict] = []
        self.spans: dict[str, list[tuple[str, int, int]]] = {}

    def _names(self, folder: str) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(x.base_name for x in found if not x.base_name.startswith(("_", ".")))

    def _parsed(self, path: str):
        with self.store.open_input_stream(f"{self.path}/{path}") as stream:
            return json.loads(stream.read())

    def refresh(self) -> None:
        names = self._names("manifests")
        if len(names) > len(self.manifests):
            checkpoints = self._names("checkpoints")
            if checkpoints and int(checkpoints[-1].split(".")[0]) >= len(self.manifests):
                self.manifests = self._parsed(f"checkpoints/{checkpoints[-1]}")
            self.manifests += [self._parsed(f"manifests/{name}") for name in names[len(self.manifests) :]]
            if [m["number"] for m in self.manifests] != list(range(len(names))):
                raise Corruption("manifests are not contiguous")

    def last(self) -> int:
        """The last committed position, -1 for an empty log."""
        self.refresh()
        return self.manifests[-1]["last_global_position"] if self.manifests else -1

    def _files(self, batch: str) -> list[tuple[str, int, int]]:
        if batch not in self.spans:
            found = []
            for name in self._names(f"batches/{batch}"):
                path = f"{self.path}/batches/{batch}/{name}"
                with self.store.open_input_file(path) as handle:
                    spans = list(_group_spans(pq.ParquetFile(handle).metadata))
                if spans:
                    found.append((path, min(s[1] for s in spans), max(s[2] for s in spans)))
            self.spans[batch] = found
        return self.spans[batch]

    def slices(self, after: int, upto: int) -> list[Slice]:
        self.refresh()
        near = [m for m in self.manifests if m["last_global_position"] > after and m["last_global_position"] - m["rows"] + 1 <= upto]
        return [Slice(file, after, upto) for m in near for file, low, high in self._files(m["batch"]) if high > after and low <= upto]


def _group_spans(metadata: pq.FileMetaData) -> Iterator[tuple[int, int, int]]:
    """(row group, least position, greatest position) of the groups with rows."""
    for g in range(metadata.num_row_groups):
        group = metadata.row_group(g)
        column = next(group.column(c) for c in range(group.num_columns) if group.column(c).path_in_schema == POSITION)
        if group.num_rows:
            yield g, column.statistics.min, column.statistics.max


def read_slice(path: str, part: Slice, columns: list[str]) -> Iterator[pa.RecordBatch]:
    store, _ = opened(path)
    with store.open_input_file(part.file) as handle:
        file = pq.ParquetFile(handle)
        groups = [g for g, low, high in _group_spans(file.metadata) if high > part.after and low <= part.upto]
        for batch in file.iter_batches(ROWS, row_groups=groups, columns=columns):
            at = batch.column(POSITION)
            kept = batch.filter(pc.and_(pc.greater(at, part.after), pc.less_equal(at, part.upto)))
            if kept.num_rows:
                yield kept.select(columns)


class _Options:
    def __init__(self, options: dict, schema: StructType):
        if not options.get("path"):
            raise InvalidValue("event_log: path is missing")
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        self.after, self.upto = int(options.get("after", -1)), int(options.get("upto", 2**63 - 1))
        self.max_events = int(options.get("max_events", 1_000_000))
        if self.max_events < 1:
            raise InvalidValue("event_log: max_events must be positive")


class EventLogReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return LogFiles(self.options.path).slices(self.options.after, self.options.upto)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from read_slice(self.options.path, partition, self.options.columns)


class EventLogStreamReader(DataSourceStreamReader):
    """Keeps the end of the last planned batch, from which the next one's is counted. After a restart Spark plans
    the last batch of its checkpoint first, which tells where it stands."""

    def __init__(self, options: _Options):
        self.options, self.files, self.at = options, None, None

    def __getstate__(self) -> dict:
        """Tasks read slices; what the driver knows of the log isn't sent to them."""
        return {"options": self.options, "files": None, "at": self.at}

    def _log(self) -> LogFiles:
        if self.files is None:
            self.files = LogFiles(self.options.path)
        return self.files

    def initialOffset(self) -> dict:
        return {"position": self.options.after}

    def latestOffset(self) -> dict:
        at = self.options.after if self.at is None else self.at
        self.at = max(at, min(self._log().last(), at + self.options.max_events))
        return {"position": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.at is None:
            self.at = end["position"]
        return self._log().slices(start["position"], end["position"])

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from read_slice(self.options.path, partition, self.options.columns)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint has it; the log keeps nothing for its readers."""


class EventLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schemas.STORED_EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventLogReader(_Options(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EventLogStreamReader(_Options(self.options, schema))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship(spark)
    spark.dataSource.register(EventLogSource)
