"""Snapshots: a projection and its cursor as immutable Parquet folders named by position."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from palimpsest import schema
from palimpsest.errors import Corruption, InvalidValue
from palimpsest.operators.replay import Cursor, Snapshot, state_problems
from palimpsest.operators.view import Projection
from palimpsest.sources.storage import content_digest

TABLES = {"node_revisions": schema.NODE_REVISION, "facts": schema.STORED_FACT, "supersessions": schema.SUPERSESSION, "retractions": schema.RETRACTION}


class SnapshotStore:
    """save() is idempotent for equal content and refuses other content at the same position;
    load_latest() takes the greatest position and checks what it reads."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "memory"):
        if not prefix or not prefix.replace("-", "").replace("_", "").isalnum():
            raise InvalidValue("snapshot prefix must be letters, digits, - and _")
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix
        self._jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._jpath(self.path))

    def _folder(self, position: int) -> str:
        return f"{self.path}/{self.prefix}-{position:020d}"

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._jpath(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def positions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(self.path))]
        return sorted(int(n[len(self.prefix) + 1 :]) for n in names if n.startswith(f"{self.prefix}-") and n[len(self.prefix) + 1 :].isdigit())

    def save(self, snapshot: Snapshot) -> None:
        position = snapshot.cursor.global_position
        if position is None or snapshot.cursor.stream_versions is None:
            raise InvalidValue("a snapshot needs a cursor")
        if position != snapshot.projection.last_position:
            raise InvalidValue("cursor and projection differ in position")
        tables = {name: getattr(snapshot.projection, name) for name in TABLES} | {"streams": snapshot.cursor.stream_versions}
        digests = {name: content_digest(df) for name, df in tables.items()}
        if position in self.positions():
            if json.loads(self._read_text(f"{self._folder(position)}/cursor.json"))["digests"] != digests:
                raise Corruption(f"another snapshot exists at {position}")
            return
        draft = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{draft}/{name}")
        out = self._fs.create(self._jpath(f"{draft}/cursor.json"))
        out.write(bytearray(json.dumps({"position": position, "digests": digests}).encode()))
        out.close()
        if not self._fs.rename(self._jpath(draft), self._jpath(self._folder(position))):
            self._fs.delete(self._jpath(draft), True)
            raise Corruption(f"another snapshot exists at {position}")

    def load_latest(self) -> Snapshot | None:
        found = self.positions()
        if not found:
            return None
        folder = self._folder(found[-1])
        cursor = json.loads(self._read_text(f"{folder}/cursor.json"))
        if cursor["position"] != found[-1]:
            raise Corruption("folder name and cursor differ")
        tables = {name: self.spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in TABLES.items()}
        streams = self.spark.read.schema("stream_id string, stream_version bigint").parquet(f"{folder}/streams")
        for name, df in (tables | {"streams": streams}).items():
            if content_digest(df) != cursor["digests"][name]:
                raise Corruption(f"table {name} of snapshot {found[-1]} is damaged")
        projection = Projection(tables["node_revisions"], tables["facts"], tables["supersessions"], tables["retractions"], found[-1])
        bad = state_problems(projection).limit(1).collect()
        if bad:
            raise Corruption(f"snapshot {found[-1]}: {bad[0]['error']} {bad[0]['detail']}")
        return Snapshot(Cursor(found[-1], streams), projection)
