"""A sink of files: each row's bytes become a file of its own, by a data source with a commit.

A task writes every file under a name of its own beside its place and renames it when it is whole, so neither readers nor a killed
task see half a file; a task that is run twice writes the same files twice. Finished tasks leave a list of their files in the
job's folder. When all have ended, the driver writes how many files and bytes there are and clears that folder; when the job fails, the
files that the lists name are removed. Paths may lie in any store that pyarrow knows by its address (a plain path is a shared folder).
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "pagemill_files"
DONE = "_files.json"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root, self.job = root.rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.root)
        me, names, made, size = uuid.uuid4().hex, [], set(), 0
        for batch in iterator:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if name is None or not content.is_valid:
                    continue
                if ".." in name.split("/") or name.startswith("/"):
                    raise ValueError(f"a file outside the folder: {name}")
                folder, _, last = f"{root}/{name}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/._{me}_{last}"
                try:
                    with store.open_output_stream(part) as out:
                        out.write(content.as_buffer())
                    store.move(part, f"{folder}/{last}")
                except BaseException:
                    with contextlib.suppress(OSError):
                        store.delete_file(part)
                    raise
                names.append(name)
                size += content.as_buffer().size
        store.create_dir(f"{root}/{self.job}", recursive=True)
        with store.open_output_stream(f"{root}/{self.job}/{me}.json") as out:
            out.write(json.dumps(names).encode())
        return Written(len(names), size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        store.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        with store.open_output_stream(f"{root}/{DONE}") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        for found in store.get_file_info(fs.FileSelector(f"{root}/{self.job}", allow_not_found=True)):
            with store.open_input_stream(found.path) as f:
                names = json.loads(f.read())
            for name in names:
                with contextlib.suppress(OSError):
                    store.delete_file(f"{root}/{name}")
        self._clear(store, root)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        with contextlib.suppress(OSError):
            store.delete_dir(f"{root}/{self.job}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> dict[str, int]:
    """Each row's content as root/path; a null content is no file. Gives the numbers of files and bytes that were written."""
    df.sparkSession.dataSource.register(FileSink)
    df.select(df[path].cast("string").alias("path"), df[content].cast("binary").alias("content")).write.format(FORMAT).mode("append").save(root)
    store, folder = _store(root.rstrip("/"))
    with store.open_input_stream(f"{folder}/{DONE}") as f:
        return json.loads(f.read())
