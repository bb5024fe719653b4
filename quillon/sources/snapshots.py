"""Question sets as files: YAML slices and JSON snapshots, as Spark data sources.

`slices` reads YAML files, a partition to a file: a slice's name, and entries with an id, a query, a slice of their own where they have one, expected
paths, an expected fact and their provenance.

`snapshot` reads and writes a folder of JSON files with a manifest. A task writes one file in a folder of the write's own and reports its rows and
checksum; the commit moves the files out of it and writes the manifest last, so that a reader sees a whole snapshot or none. When a write
fails, its folder is removed, so that tasks that are still at work, as killed ones may be, leave nothing either. A reader takes a partition to a file, and raises where there is no manifest, where its format
is another one or it lists no question, and where a file does not match its checksum.

Both take local or mounted folders that all machines share."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT, MANIFEST = "quillon-snapshot-1", "_snapshot.json"
SLICE = "id string, query string, slice string, expected_paths array<string>, expected_fact string, provenance string"


def local(path: str) -> Path:
    """A path without its file scheme; other schemes are an error."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a local or mounted folder: {path}")
    return Path(parts.path)


@dataclass
class File(InputPartition):
    path: str
    sha256: str | None = None


class SlicesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        home = local(self.path)
        return [File(str(p)) for p in (sorted(home.glob("*.y*ml")) if home.is_dir() else [home])]

    def read(self, partition: File) -> Iterator[tuple]:
        import yaml

        text = yaml.safe_load(Path(partition.path).read_text())
        for e in text["entries"]:
            yield e["id"], e["query"], e.get("slice", text["name"]), [str(x) for x in e.get("expected_paths") or []], e.get("expected_fact"), e.get("provenance", "hand-written")


class Slices(DataSource):
    """`spark.read.format("slices").load(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "slices"

    def schema(self) -> str:
        return SLICE

    def reader(self, schema: StructType) -> DataSourceReader:
        return SlicesReader(self.options["path"])


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        home = local(self.path)
        if not (home / MANIFEST).exists():
            raise ValueError(f"no whole snapshot at {home}")
        manifest = json.loads((home / MANIFEST).read_text())
        if manifest.get("format") != FORMAT:
            raise ValueError(f"not a {FORMAT}: {home}")
        if not sum(f["rows"] for f in manifest["files"]):
            raise ValueError(f"a snapshot without questions: {home}")
        return [File(str(home / f["name"]), f["sha256"]) for f in manifest["files"]]

    def read(self, partition: File) -> Iterator[tuple]:
        data = Path(partition.path).read_bytes()
        if hashlib.sha256(data).hexdigest() != partition.sha256:
            raise ValueError(f"checksum of {partition.path}")
        for line in data.splitlines():
            row = json.loads(line)
            yield tuple(row.get(n) for n in self.names)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


class SnapshotWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.run = path, uuid.uuid4().hex
        home = local(path)
        if (home / MANIFEST).exists() and not overwrite:
            raise ValueError(f"there is a snapshot at {home}")
        self._own(home).mkdir(parents=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """One file, in the folder of this write, which no reader looks into; a task that is tried again writes another one, and one that
        begins after the write has ended raises, as the folder is gone."""
        name, digest, n = f"{self.run}-{uuid.uuid4().hex}.json", hashlib.sha256(), 0
        with (self._own(local(self.path)) / name).open("wb") as out:
            for row in rows:
                line = json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n"
                out.write(line)
                digest.update(line)
                n += 1
        return Written(name, n, digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        home, files = local(self.path), [m for m in messages if m]
        for m in files:
            os.replace(self._own(home) / m.name, home / m.name)
        manifest = {"format": FORMAT, "files": [{"name": m.name, "rows": m.rows, "sha256": m.sha256} for m in files]}
        (self._own(home) / MANIFEST).write_text(json.dumps(manifest))
        os.replace(self._own(home) / MANIFEST, home / MANIFEST)  # from here on readers see the new snapshot
        named = {m.name for m in files}
        for old in home.glob("*.json"):
            if old.name != MANIFEST and old.name not in named:
                old.unlink()
        self._tidy(home)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._tidy(local(self.path))

    def _own(self, home: Path) -> Path:
        return home / f".{self.run}"

    def _tidy(self, home: Path) -> None:
        for _ in range(10):  # a task may make its file while the others are removed
            shutil.rmtree(self._own(home), ignore_errors=True)
            if not self._own(home).exists():
                return


class Snapshot(DataSource):
    """`df.write.format("snapshot").save(folder)` and `spark.read.format("snapshot").schema(...).load(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        raise ValueError("a snapshot is read with a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SnapshotReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SnapshotWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Slices)
    spark.dataSource.register(Snapshot)
