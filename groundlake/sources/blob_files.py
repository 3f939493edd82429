"""Raw files from rows, one file a row, all or none (SNK-7)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class BlobFiles(DataSource):
    """``df.write.format("blob_files").mode("append").save(path)`` for ``name string, content binary``.

    A row becomes the file ``path/name``; a null content is an empty file, and a file that
    is there is replaced. Tasks write aside; the files are moved into place when all tasks
    have ended, and an aborted job removes what it wrote. Paths are those of pyarrow's file
    systems.
    """

    @classmethod
    def name(cls) -> str:
        return "blob_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Files(self.options["path"], [f.name for f in schema.fields])


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Files(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.job = path, columns, uuid.uuid4().hex
        store, _, aside = self._at()
        store.create_dir(aside, recursive=True)  # tasks that come after an abort find it gone and fail

    def _at(self) -> tuple[fs.FileSystem, str, str]:
        store, top = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return store, top, f"{top}/_writing-{self.job}"

    def write(self, rows: Iterator) -> _Written:
        store, top, aside = self._at()
        mine = f"{aside}/{uuid.uuid4().hex}"  # another attempt of the task writes elsewhere
        store.create_dir(mine, recursive=False)
        moves = []
        for row in rows:
            name, content = row[self.columns.index("name")], row[self.columns.index("content")]
            if not name or "/" in name or name.startswith("_writing-"):
                raise ValueError(f"not a file name: {name!r}")
            with store.open_output_stream(f"{mine}/{name}") as out:
                out.write(bytes(content or b""))
            moves.append((f"{mine}/{name}", f"{top}/{name}"))
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        store, _, aside = self._at()
        moves = [x for m in messages if m for x in m.moves]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            store.delete_dir(aside)
            raise ValueError("two rows have one name")
        for source, to in moves:
            store.move(source, to)
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _, aside = self._at()
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)
