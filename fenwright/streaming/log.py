"""A shared event log: entries with ascending ids, and a stream of them that resumes where it stopped.

An entry is a file named by its id, created only where none of that name is, so writers on different machines never share
an id. The stream's offset is the last id read, kept by Spark's checkpoint; so after a restart no entry is lost or doubled, and one batch
reads the same entries whenever it is repeated. A heartbeat is a row without id, once for each period in which
the stream looks, so that readers can tell a silent log from a dead one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id long, type string, message string, created_at timestamp, data map<string,string>"
DIGITS = 15
#: Entries that one task reads; entries that one batch reads at most.
A_TASK, A_BATCH = 1000, 100_000
HEARTBEAT = "heartbeat"
#: Most tries to get the next id against other writers.
TRIES = 1000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _ids(files: fs.FileSystem, root: str) -> list[int]:
    """Ids of whole entries, ascending; an entry is given its name when it is whole."""
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.type == fs.FileType.File and f.base_name.isdigit())


class EventLog:
    """Writing and looking up entries of the log at a path."""

    def __init__(self, path: str) -> None:
        self.files, self.root = _place(path)
        self.root = self.root.rstrip("/")
        self.files.create_dir(self.root, recursive=True)

    def _read(self, id: int) -> dict:
        with self.files.open_input_stream(f"{self.root}/{id:0{DIGITS}d}") as f:
            return json.loads(f.read())

    def publish(self, type: str, message: str, data: Mapping[str, object] | None = None) -> int:
        """Append an entry; its id. Ids are those that no other writer has taken first."""
        ids = _ids(self.files, self.root)
        for id in range(ids[-1] + 1 if ids else 1, (ids[-1] if ids else 0) + TRIES):
            entry = {"id": id, "type": type, "message": message, "created_at": int(time.time() * 1e6), "data": {k: v if isinstance(v, str) else json.dumps(v) for k, v in (data or {}).items()}}
            if self._create(id, json.dumps(entry, ensure_ascii=False).encode()):
                return id
        raise RuntimeError("too many writers")

    def _create(self, id: int, content: bytes) -> bool:
        """Put the entry under its id, whole at once; whether the id was free."""
        name = f"{self.root}/{id:0{DIGITS}d}"
        if isinstance(self.files, fs.LocalFileSystem):
            import os

            try:  # a link to a whole file is made at once, and fails where the name is taken
                part = f"{self.root}/.{id}-{os.getpid()}-{time.monotonic_ns()}"
                with open(part, "xb") as f:
                    f.write(content)
                os.link(part, name)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        # Where files cannot be linked, a move onto a name that is taken fails.
        part = f"{self.root}/.{id}-{time.time_ns()}"
        with self.files.open_output_stream(part) as f:
            f.write(content)
        try:
            if self.files.get_file_info(name).type != fs.FileType.NotFound:
                raise OSError(name)
            self.files.move(part, name)
        except OSError:
            self.files.delete_file(part)
            return False
        return True

    def after(self, id: int, most: int = 100) -> list[dict]:
        """The entries after an id, the first `most`."""
        return [self._read(i) for i in _ids(self.files, self.root) if i > id][:most]

    def latest(self) -> dict | None:
        ids = _ids(self.files, self.root)
        return self._read(ids[-1]) if ids else None


class EventLogSource(DataSource):
    """Format `event_log`: options `path`, `after` (the id to start after; all entries if not given) and `heartbeat` (seconds; none if not given)."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return EventLogReader(self.options["path"], int(self.options.get("after", 0)), float(self.options.get("heartbeat", 0)))


class Entries(InputPartition):
    def __init__(self, first: int, last: int, beat: int = 0) -> None:
        self.first, self.last, self.beat = first, last, beat


class EventLogReader(DataSourceStreamReader):
    def __init__(self, path: str, after: int, heartbeat: float) -> None:
        self.path, self.start, self.heartbeat = path, after, heartbeat
        self.at: int | None = None

    def _beat(self) -> int:
        return int(time.time() // self.heartbeat) if self.heartbeat > 0 else 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.start, "beat": self._beat()}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the next batch: the last entry there is, A_BATCH beyond the last batch at most."""
        files, root = _place(self.path)
        ids = [i for i in _ids(files, root.rstrip("/")) if self.at is None or i > self.at]
        last = ids[:A_BATCH][-1] if ids and self.at is not None else ids[-1] if ids else self.at if self.at is not None else self.start
        return {"id": max(last, self.start), "beat": self._beat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["id"]
        beats = [Entries(0, 0, end["beat"])] if end["beat"] > start["beat"] else []
        return [Entries(i, min(i + A_TASK, end["id"] + 1)) for i in range(start["id"] + 1, end["id"] + 1, A_TASK)] + beats

    def read(self, partition: Entries) -> Iterator[tuple]:
        import datetime

        if partition.beat:
            yield None, HEARTBEAT, "", datetime.datetime.fromtimestamp(partition.beat * self.heartbeat, datetime.UTC), {}
            return
        files, root = _place(self.path)
        for id in range(partition.first, partition.last):
            try:
                with files.open_input_stream(f"{root.rstrip('/')}/{id:0{DIGITS}d}") as f:
                    e = json.loads(f.read())
            except FileNotFoundError:  # ids may have gaps
                continue
            yield e["id"], e["type"], e["message"], datetime.datetime.fromtimestamp(e["created_at"] / 1e6, datetime.UTC), e["data"]

    def commit(self, end: dict) -> None:
        """Spark keeps the offset; entries stay for other readers."""
