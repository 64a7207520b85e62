"""A data source that writes lines as whole files under their public names.

`format("public_files")` takes rows (kind, file, line), sorted by file within a
partition. Tasks write complete files into folders of their own in a staging
area beside the public one, and tell the driver that folder's name and no more.
The commit moves the files of the attempts that Spark chose, one rename each, so
whatever a second or failed attempt wrote is never seen; an abort deletes the
staging area and leaves the public folder as it was. A row without a line asks
for its file to be removed by the commit, after all moves.

Lists of the published files go to `<root>.published/kind=K/job=J/`, as CSV of
file and line count, moved by the same commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "public_files"
SCHEMA = "kind string, file string, line string"
# Renames the commit has under way at once.
MOVES = 32
# An attempt's own lists: files by kind with their line counts, and files to remove.
_LISTS, _GONE = "_lists", "_gone"


@dataclass
class Attempt(WriterCommitMessage):
    """The folder that a task's attempt wrote, below the staging area."""

    folder: str


def published_lists(root: str) -> str:
    return f"{root.rstrip('/')}.published"


def _staging(root: str, job: str) -> str:
    return f"{root.rstrip('/')}.staging-{job}"


class PublicFileWriter(DataSourceArrowWriter):
    """Writer of one job; `documents` names the header and footer of each kind of file."""

    def __init__(self, root: str, job: str, documents: dict[str, tuple[str, str]], drop_lists: list[str]) -> None:
        self.root, self.job, self.documents, self.drop_lists = root.rstrip("/"), job, documents, drop_lists

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, base = self._store()
        attempt = uuid.uuid4().hex
        home = f"{_staging(base, self.job)}/{attempt}"
        opened: dict[str, object] = {}
        kind = name = out = None
        lines = 0

        def stream(path: str):
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            return store.open_output_stream(path)

        def note(path: str, text: str) -> None:
            """A line of one of the attempt's own lists, which stay open: one for each kind, and the removals."""
            if path not in opened:
                opened[path] = stream(f"{home}/{path}")
            opened[path].write(f"{text}\n".encode())

        def finish() -> None:
            if out is not None:
                out.write(self.documents.get(kind, ("", ""))[1].encode())
                out.close()
                quoted = name.replace('"', '""')
                note(f"{_LISTS}/{kind}.csv", f'"{quoted}",{lines}')

        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("kind", "file", "line")]
                for row_kind, file, line in zip(*columns, strict=True):
                    if line is None:
                        note(_GONE, file)
                        continue
                    if file != name:
                        finish()
                        kind, name, lines, out = row_kind, file, 0, stream(f"{home}/files/{file}")
                        out.write(self.documents.get(kind, ("", ""))[0].encode())
                    out.write(f"{line}\n".encode())
                    lines += 1
            finish()
        finally:
            for handle in (out, *opened.values()):
                if handle is not None and not handle.closed:
                    handle.close()
        return Attempt(attempt)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base = self._store()
        staging, lists = _staging(base, self.job), published_lists(base)
        made: set[str] = set()

        def put(source: str, target: str) -> None:
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            store.move(source, target)

        def files_below(folder: str) -> list[str]:
            selector = fs.FileSelector(folder, allow_not_found=True, recursive=True)
            return [info.path for info in store.get_file_info(selector) if info.is_file]

        def remove(file: str) -> None:
            if store.get_file_info(f"{base}/{file}").is_file:
                store.delete_file(f"{base}/{file}")
            folder = f"{base}/{file}".rsplit("/", 1)[0]
            if folder != base and store.get_file_info(folder).type == fs.FileType.Directory:
                if not store.get_file_info(fs.FileSelector(folder)):
                    store.delete_dir(folder)

        attempts = [f"{staging}/{message.folder}" for message in messages if message is not None]
        with ThreadPoolExecutor(MOVES) as pool:
            # Lists first: should the rest be cut short, they name every file that may stand.
            for home in attempts:
                for path in files_below(f"{home}/{_LISTS}"):
                    kind = path.rsplit("/", 1)[1].removesuffix(".csv")
                    put(path, f"{lists}/kind={kind}/job={self.job}/{home.rsplit('/', 1)[1]}.csv")
            for home in attempts:
                start = f"{home}/files/"
                list(pool.map(lambda p, s=start: put(p, f"{base}/{p.removeprefix(s)}"), files_below(start)))
            for home in attempts:
                if store.get_file_info(f"{home}/{_GONE}").is_file:
                    with store.open_input_stream(f"{home}/{_GONE}") as gone:
                        # In order, as two files may share the folder that goes with the last of them.
                        for line in gone.read().decode().splitlines():
                            remove(line)
        for folder in self.drop_lists:
            if store.get_file_info(f"{lists}/{folder}").type == fs.FileType.Directory:
                store.delete_dir(f"{lists}/{folder}")
        self._clear(store, staging)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = self._store()
        self._clear(store, _staging(base, self.job))

    @staticmethod
    def _clear(store: fs.FileSystem, staging: str) -> None:
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class PublicFiles(DataSource):
    """Options: path (a URI that tasks reach), job (a name of its own), documents and drop_lists (JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> PublicFileWriter:
        told = {key: json.loads(self.options.get(key, empty)) for key, empty in (("documents", "{}"), ("drop_lists", "[]"))}
        documents = {kind: tuple(ends) for kind, ends in told["documents"].items()}
        return PublicFileWriter(self.options["path"], self.options["job"], documents, told["drop_lists"])


def write_public_files(
    lines, root: str, job: str, documents: dict[str, tuple[str, str]] | None = None, drop_lists: list[str] | None = None
) -> None:
    """Write (kind, file, line) rows, sorted by file within each partition, below the URI `root`."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(PublicFiles)
    (
        lines.select("kind", "file", "line")
        .write.format(FORMAT)
        .mode("append")
        .option("job", job)
        .option("documents", json.dumps(documents or {}))
        .option("drop_lists", json.dumps(drop_lists or []))
        .save(root)
    )
