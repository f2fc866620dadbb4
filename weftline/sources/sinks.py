"""Writers. Spark's commit protocol makes each of them all-or-nothing."""

from __future__ import annotations

import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


READ_BYTES = 8 << 20  # of Markdown files that a task hands on at a time


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; every field is written, also NULL ones."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_json_documents(df: DataFrame, path: str, key: str, payload: str = "payload") -> None:
    """JSON documents as JSON lines of (key, document), sorted by key.

    A file or folder per document would mean millions of them.
    """
    rows = df.select(key, F.col(payload).alias("document")).repartitionByRange(key).sortWithinPartitions(key)
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """Markdown volumes as a table of (doc_id, volume, markdown).

    A document per file would mean millions of tiny files; the table keeps
    documents whole and sorted by id.
    """
    keys = [c for c in ("doc_id", "volume") if c in documents.columns]
    documents.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


class _Committed(WriterCommitMessage):
    """A task has put all its files in place."""


class _MarkdownWriter(DataSourceArrowWriter):
    def __init__(self, path: str, fanout: int, overwrite: bool) -> None:
        self._path, self._fanout, self._overwrite = path, fanout, overwrite
        self._waiting = f"_temporary-{uuid.uuid4().hex}"

    def _store(self) -> tuple:
        """The file system of the path and the path in it; made anew in every task."""
        return fs.FileSystem.from_uri(self._path) if "://" in self._path or self._path.startswith("file:") else (fs.LocalFileSystem(), self._path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = self._store()
        task = f"{root}/{self._waiting}/{uuid.uuid4().hex}"
        store.create_dir(task, recursive=True)
        made: set[str] = set()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = urllib.parse.quote(str(name), safe="") + ".md"
                folder = f"{zlib.crc32(file.encode()) % self._fanout:04d}/" if self._fanout else ""
                with store.open_output_stream(f"{task}/{file}") as out:
                    out.write((body or "").encode())
                if folder and folder not in made:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                # whole files only are moved to their place, and a task that is run again writes the same ones
                store.move(f"{task}/{file}", f"{root}/{folder}{file}")
        return _Committed()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        store.delete_dir(f"{root}/{self._waiting}") if store.get_file_info(f"{root}/{self._waiting}").type == fs.FileType.Directory else None
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self._waiting}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self._waiting}")


class MarkdownFiles(DataSource):
    """One Markdown file per row of (name, markdown); a task writes as many as it has rows.

    ``path`` is a folder that all executors reach, with or without a scheme.
    Files are written aside and moved when whole, so a killed task leaves no
    half file; what it had moved is written again, the same. ``_SUCCESS`` is
    put in when all tasks are done. ``fanout`` spreads the files over so many
    folders; 0 puts them all into one. Names are percent-encoded. With mode
    overwrite the folder is emptied first.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        made = _MarkdownWriter(self.options["path"], int(self.options.get("fanout", "0")), overwrite)
        store, root = made._store()
        if overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir_contents(root)
        store.create_dir(root, recursive=True)
        return made


def write_markdown_files(documents: DataFrame, path: str, name: str = "doc_id", markdown: str = "markdown", fanout: int = 0) -> None:
    """A Markdown file per document; see :class:`MarkdownFiles`."""
    documents.sparkSession.dataSource.register(MarkdownFiles)
    rows = documents.select(F.col(name).cast("string").alias("name"), F.col(markdown).alias("markdown"))
    rows.write.format("markdown_files").option("fanout", fanout).mode("overwrite").save(path)


def read_markdown_files(spark: SparkSession, path: str, fanout: int = 0, partitions: int | None = None) -> DataFrame:
    """(name, markdown) of the files that :func:`write_markdown_files` put under ``path`` with that ``fanout``.

    A folder is listed by one task and its files are read by ``partitions``
    tasks (default: the session's shuffle partitions): neither the driver nor
    the planner sees a file, of which there may be millions.
    """
    def find() -> tuple:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = find()
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                files = [i.path for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and i.path.endswith(".md")]
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = find()

        def rows(names: list[str], bodies: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], names=["name", "markdown"])

        for batch in batches:
            names, bodies, held = [], [], 0
            for file in batch["file"].to_pylist():
                with store.open_input_stream(file) as given:
                    body = given.read()
                names.append(urllib.parse.unquote(file.rsplit("/", 1)[-1].removesuffix(".md")))
                bodies.append(body.decode())
                held += len(body)
                if held >= READ_BYTES:
                    yield rows(names, bodies)
                    names, bodies, held = [], [], 0
            yield rows(names, bodies)

    _, root = find()
    inside = [f"{root}/{n:04d}" for n in range(fanout)]
    folders = spark.createDataFrame([(f,) for f in inside or [root]], "folder string").repartition(max(1, fanout), "folder")
    files = folders.mapInArrow(listed, "file string")
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(count, "file").mapInArrow(read, "name string, markdown string")


def write_lines(lines: DataFrame, path: str, order_by: list[str]) -> None:
    """Ordered line table as text: part files in order give the document."""
    lines.orderBy(*order_by).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
