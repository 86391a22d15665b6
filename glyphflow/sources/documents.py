"""A data source of documents with pages: tasks read ranges of pages, and write files that appear whole or not at all.

Reading.  A large file is cut into slices of its pages, small files are packed together, so 500 pages of one file are
as many tasks as its bytes ask for.  Only a task opens its files; the driver lists names and lengths.  Conditions on
``path`` leave out files, those on ``page_number`` leave out pages before they are extracted: given to ``read_pages``, or
taken from the query's own filters with ``pushdown``.  The latter is for a frame that a plan scans once: Spark 4.1 keeps
one set of pushed conditions for all scans of a loaded frame, so a union of two filters of it would lose rows.  What a
page holds is the work of a format: the text layer of PDFs where PyMuPDF is installed, text with form feeds between its pages, or any
object of the same shape, named ``module:object``.  A file or a page that fails is a row with its error.

Writing.  Every document becomes one file of its own name.  A task writes each file under a temporary name and renames
it, then lists its files; the job commits by a file that names the lists of the attempts that count, so what tasks or
jobs that died have left is never read, and one message a task goes to the driver, whatever the number of files.

Tasks open files themselves, so the folder must be in a store that pyarrow knows (a mounted folder, s3, gcs, hdfs);
``sources.pdf.read_spans`` reads whole files from any store that Spark can read.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .pdf import SPANS, opened, spans_of
from .store import PENDING, Pending, store

NAME = "paged_documents"
#: Bytes of files that one task reads.
TASK_BYTES = 8 << 20
#: Rows of a batch.
ROWS = 512
#: Where a folder lists the files of its finished writes, and what marks one as finished.
COMMITTED, DONE = "_committed", "done"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


class FormFeed:
    """Text whose pages end with form feeds: a row for each page."""

    ddl = "path string, page_number int, text string, error string"

    def open(self, data: bytes, password: str | None) -> list[bytes]:
        return data.split(b"\f")

    def rows(self, pages: list[bytes], number: int) -> Iterator[dict]:
        yield {"text": pages[number - 1].decode()}


class Pdf:
    """The text layer of PDFs: a row for each span."""

    ddl = SPANS

    def open(self, data: bytes, password: str | None):
        return opened(data, password)

    def rows(self, document, number: int) -> Iterator[dict]:
        return spans_of(document[number - 1])


FORM_FEED, PDF = FormFeed(), Pdf()


def format_named(name: str):
    module, _, name = name.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Wanted:
    """The pages and paths that pushed conditions leave; all of them hold."""

    low: int = 1
    high: int = 1 << 31
    pages: set[int] | None = None
    paths: list[Filter] = field(default_factory=list)

    def push(self, f: Filter) -> bool:
        """Takes a condition if it can; Spark need not judge paths again."""
        column = getattr(f, "attribute", None)
        if column == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
            self.paths.append(f)
            return True
        if column == ("page_number",):
            if isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pages = own if self.pages is None else self.pages & own
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
        return False

    def path(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: lambda v: v in path}
        return all(tests[type(f)](f.value) for f in self.paths)

    def of(self, first: int, last: int) -> list[int]:
        """The wanted ones of the pages first to last."""
        found = range(max(first, self.low), min(last, self.high) + 1)
        return [n for n in found if n in self.pages] if self.pages is not None else list(found)


@dataclass
class Slice(InputPartition):
    """Files of one task; of a single file, one of several equal parts of its pages."""

    files: list[str]
    part: int = 0
    parts: int = 1


def packed(files: list[tuple[str, int]], task_bytes: int) -> Iterator[Slice]:
    """Large files in slices, small ones together."""
    held, size = [], 0
    for name, n in files:
        if n > task_bytes:
            parts = -(-n // task_bytes)
            yield from (Slice([name], i, parts) for i in range(parts))
            continue
        if held and size + n > task_bytes:
            yield Slice(held)
            held, size = [], 0
        held.append(name)
        size += n
    if held:
        yield Slice(held)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.ending = options["path"], options.get("ending", "")
        self.task_bytes, self.password = int(options.get("task_bytes", TASK_BYTES)), options.get("password")
        self.format_name = options.get("format", f"{__name__}:PDF")
        self.wanted = Wanted(int(options.get("first_page", 1)), int(options.get("last_page", 1 << 31)))
        if "beginning" in options:
            self.wanted.paths.append(StringStartsWith(("path",), options["beginning"]))

    def partitions(self) -> list[Slice]:
        files = [(n, size) for n, size in listed(self.folder) if n.lower().endswith(self.ending) and self.wanted.path(n)]
        return list(packed(sorted(files), self.task_bytes))

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        """partition: None where there are no files."""
        made = format_named(self.format_name)
        schema = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in made.ddl.split(", ")])
        rows: list[dict] = []
        for name in partition.files if partition else []:
            for row in self._rows(made, name, partition):
                rows.append(row)
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _rows(self, made, name: str, partition: Slice) -> Iterator[dict]:
        try:
            files, root = store(self.folder)
            with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                document = made.open(stream.read(), self.password)
            n = len(document)
        except Exception as e:  # whatever a broken file makes a library raise
            if not partition.part:  # once for all slices
                yield {"path": name, "error": f"{type(e).__name__}: {e}"}
            return
        first, last = n * partition.part // partition.parts + 1, n * (partition.part + 1) // partition.parts
        for number in self.wanted.of(first, last):
            try:
                found = list(made.rows(document, number))
            except Exception as e:  # one page of it
                found = [{"error": f"{type(e).__name__}: {e}"}]
            yield from ({"path": name, "page_number": number} | row for row in found)


class PushingReader(PagedReader):
    """Takes conditions from the query's own filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.push(f):
                yield f


def listed(folder: str) -> list[tuple[str, int]]:
    """Names below a folder and lengths: of a folder with finished writes, what these have committed."""
    files, root = store(folder)
    committed = f"{root}/{COMMITTED}"
    if files.get_file_info(committed).type == fs.FileType.NotFound:
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return [(f.path.removeprefix(f"{root}/"), f.size) for f in found if f.is_file and not f.path.removeprefix(f"{root}/").startswith(("_", "."))]
    names: dict[str, int] = {}
    for job in files.get_file_info(fs.FileSelector(committed)):
        if files.get_file_info(f"{job.path}/{DONE}").is_file:
            for part in _lines(files, f"{job.path}/{DONE}"):
                names |= {x["name"]: x["n_bytes"] for x in _lines(files, f"{job.path}/{part['list']}")}
    return list(names.items())


def _lines(files: fs.FileSystem, path: str) -> list[dict]:
    with files.open_input_stream(path, compression=None) as stream:
        return [json.loads(line) for line in stream.read().splitlines()]


@dataclass
class Written(WriterCommitMessage):
    list: str | None


class PagedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _put(self, name: str, data: bytes) -> None:
        file = Pending(self.folder, name, self.job)
        file.write(data)
        file.commit()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        made = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name.startswith(("_", ".", "/")) or ".." in name.split("/"):
                    raise ValueError(f"not a file name: {name!r}")
                data = content.encode() if isinstance(content, str) else content or b""
                self._put(name, data)
                made.append(json.dumps({"name": name, "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}))
        if not made:
            return Written(None)
        own = f"{uuid.uuid4().hex}.json"
        self._put(f"{COMMITTED}/{self.job}/{own}", "\n".join(made).encode())
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.folder)
        before = files.get_file_info(fs.FileSelector(f"{root}/{COMMITTED}", allow_not_found=True))
        lists = [json.dumps({"list": m.list}) for m in messages if m and m.list]
        self._put(f"{COMMITTED}/{self.job}/{DONE}", "\n".join(lists).encode())
        if self.overwrite:
            for job in before:
                if job.base_name != self.job:
                    files.delete_dir(job.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = store(self.folder)
        if files.get_file_info(f"{root}/{PENDING}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{PENDING}/{self.job}")


class PagedDocuments(DataSource):
    """Options: path; to read: format (module:object), task_bytes, ending, password, first_page, last_page, beginning
    (of paths), pushdown (true or false)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return format_named(self.options.get("format", f"{__name__}:PDF")).ddl

    def reader(self, schema: StructType) -> PagedReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else PagedReader
        return kind(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PagedWriter:
        return PagedWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to a session, and lets it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedDocuments)
    return spark


def read_pages(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Rows of the pages below a path, spans of PDFs if no format is named.  Options are those of PagedDocuments."""
    pages = register(spark).read.format(NAME).options(**options).load(path)
    pushes = str(options.get("pushdown", "false")).lower() == "true"
    return pages.where("path IS NOT NULL") if pushes else pages  # a condition in every plan, so that none keeps an earlier plan's


def write_files(documents: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each row (name, content: string or binary); of rows with one name one stays.

    append adds to the committed files, overwrite leaves those of this write alone.
    """
    register(documents.sparkSession)
    documents.select("name", "content").write.format(NAME).mode(mode).save(path)
