"""Files from pieces, by a data source writer that leaves either all files or none.

Each task has a stretch of the sorted pieces, which it streams into files under the job's own folder, and holds one line
at a time. A long file is cut over many tasks. When all tasks are done, a second job moves the files to their places and
copies those that were cut together, in order; a job that fails takes its folder with it. A task that is tried again writes a folder of its own, and only the folders named by the tasks that
succeeded are moved. ``folder`` may be on any file system that pyarrow reaches by its address.

Very many small files are better written as archives: a file takes at least a block of the disk, and a name in its folder.
``write_archives`` packs them into ZIP files of bounded size, the same way: all archives or none.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "quillwork_files"
JOBS = "_writing"  # jobs' own folders, below the target
MEMBERS, ARCHIVE_BYTES = 50_000, 64 << 20  # files and bytes of text after which the next archive begins
HELD = 1 << 20  # bytes of a file that are held in memory


def file_system(folder: str):
    """File system and path of an address or a plain path."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    attempt: str | None
    part: int = 0
    files: int = 0
    first: str | None = None
    last: str | None = None


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.folder)
        attempt = uuid.uuid4().hex
        base, names, path, out = f"{root}/{JOBS}/{self.job}/{attempt}", 0, None, None
        listed, first = None, None
        try:
            for batch in iterator:
                for here, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                    if here != path:
                        if out:
                            out.close()
                        if listed is None:
                            system.create_dir(base, recursive=True)
                            listed = system.open_output_stream(f"{base}/names")
                        path = here
                        first = here if names == 0 else first
                        out = system.open_output_stream(f"{base}/{names}")
                        listed.write((json.dumps(path) + "\n").encode())
                        names += 1
                    if line is not None:
                        out.write(line.encode("utf-8", "surrogatepass") + b"\n")
        finally:
            for stream in (out, listed):
                if stream:
                    stream.close()
        return Written(attempt, TaskContext.get().partitionId(), names, first, path) if names else Written(None)

    def commit(self, messages: list[Written | None]) -> None:
        """Name the folders of the tasks that succeeded; only their files are moved."""
        system, root = file_system(self.folder)
        system.create_dir(f"{root}/{JOBS}/{self.job}", recursive=True)
        with system.open_output_stream(f"{root}/{JOBS}/{self.job}/done") as out:
            out.write(json.dumps(moves(messages)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        remove_job(self.folder, self.job)


class Archives:
    """ZIP files ``00000.zip`` and so on in ``base``; a new one begins after ``MEMBERS`` files or ``ARCHIVE_BYTES`` of text."""

    def __init__(self, system, base: str, prefix: str = ""):
        self.system, self.base, self.prefix, self.n, self.size, self.stream, self.zip = system, base, prefix, 0, 0, None, None

    def add(self, path: str, chunks: Iterable[bytes], size: int) -> None:
        if self.zip and (len(self.zip.filelist) >= MEMBERS or self.size >= ARCHIVE_BYTES):
            self.close()
        if not self.zip:
            self.stream = self.system.open_output_stream(f"{self.base}/{self.prefix}{self.n:05d}.zip")
            self.zip = zipfile.ZipFile(Outward(self.stream), "w")
            self.n, self.size = self.n + 1, 0
        member = zipfile.ZipInfo(path)  # of a fixed date, so equal files make equal archives
        member.compress_type, member.file_size = zipfile.ZIP_DEFLATED, size
        with self.zip.open(member, "w") as out:
            for chunk in chunks:
                out.write(chunk)
        self.size += size

    def close(self) -> None:
        if self.zip:
            self.zip.close()
            self.stream.close()
            self.zip = None


class Outward:
    """What ``zipfile`` needs of a stream that is only written."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass


class ArchiveWriter(PieceWriter):
    """Packs files into archives, but for a task's first and last, which other tasks may have parts of, and long ones."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.folder)
        attempt = uuid.uuid4().hex
        base, names, path, out, listed = f"{root}/{JOBS}/{self.job}/{attempt}", 0, None, None, None
        packed, first, held, size = Archives(system, base), None, [], 0

        def alone():
            nonlocal out, names, size
            listed.write((json.dumps(path) + "\n").encode())
            out = system.open_output_stream(f"{base}/{names}")
            out.write(b"".join(held))
            held.clear()
            names, size = names + 1, 0

        try:
            for batch in iterator:
                for here, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                    if here != path:
                        if out:
                            out.close()
                            out = None
                        elif path is not None:
                            packed.add(path, held, size)
                            held.clear()
                            size = 0
                        path = here
                        if listed is None:
                            system.create_dir(base, recursive=True)
                            listed = system.open_output_stream(f"{base}/names")
                            first = here
                            alone()
                    if line is not None:
                        content = line.encode("utf-8", "surrogatepass") + b"\n"
                        if out:
                            out.write(content)
                        else:
                            held.append(content)
                            size += len(content)
                            if size > HELD:
                                alone()
            if path is not None and not out:
                alone()
            packed.close()
        finally:
            for stream in (out, listed, packed.stream):
                if stream:
                    stream.close()
        return Written(attempt, TaskContext.get().partitionId(), names, first, path) if names else Written(None)


def moves(messages: list[Written | None]) -> list[dict]:
    """For each task in order: its folder, whether its first file goes on one of a task before it, and the folders of
    the tasks that go on with its last file."""
    tasks = sorted((m for m in messages if m and m.attempt), key=lambda m: m.part)
    out, owner = [], None
    for before, m in zip([None, *tasks], tasks):
        goes_on = before is not None and before.last == m.first
        out.append({"attempt": m.attempt, "skip": int(goes_on), "more": []})
        if goes_on:
            owner["more"].append(m.attempt)
        if not goes_on or m.files > 1:
            owner = out[-1]
    return out


def remove_job(folder: str, job: str) -> None:
    from pyarrow import fs

    system, root = file_system(folder)
    if system.get_file_info(f"{root}/{JOBS}/{job}").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/{JOBS}/{job}")


class PieceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        kind = ArchiveWriter if self.options.get("archives") == "true" else PieceWriter
        return kind(self.options["folder"], self.options["job"])


def _written(pieces: DataFrame, folder: str, job: str, archives: bool) -> list[dict]:
    """The tasks that wrote ``pieces`` below the job's folder, in order."""
    pieces.sparkSession.dataSource.register(PieceFiles)
    keys = ["path", "place", "seq", "line"]
    ordered = pieces.filter("path is not null").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).select("path", "line")
    ordered.write.format(FORMAT).mode("append").option("folder", folder).option("job", job).option("archives", str(archives).lower()).save()
    system, root = file_system(folder)
    with system.open_input_stream(f"{root}/{JOBS}/{job}/done") as done:
        return json.loads(done.read())


def _tasks(spark, tasks: list[dict]) -> DataFrame:
    rows = [(i, t["attempt"], t["skip"], t["more"]) for i, t in enumerate(tasks)]
    return spark.createDataFrame(rows, "part int, attempt string, skip int, more array<string>").repartition(len(rows))


def write_files(pieces: DataFrame, folder: str) -> int:
    """Write the files of ``pieces`` (path, place, seq, line) below ``folder``; returns their number.

    A line ends with a line feed; a null line only makes its file exist. Files that exist already are replaced, others in
    the folder stay. Pieces without a path are left out.
    """
    from pyarrow import fs

    spark = pieces.sparkSession
    job = uuid.uuid4().hex
    try:
        tasks = _written(pieces, folder, job, False)
        if not tasks:
            return 0

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, base = file_system(folder)
            for batch in batches:
                moved = 0
                for _, attempt, skip, more in zip(*(c.to_pylist() for c in batch.columns)):
                    own = f"{base}/{JOBS}/{job}/{attempt}"
                    with there.open_input_stream(f"{own}/names") as listed:
                        names = [json.loads(x) for x in listed.read().decode().splitlines()]
                    for i, name in enumerate(names):
                        if i < skip:
                            continue
                        if i == len(names) - 1 and more:
                            with there.open_output_stream(f"{own}/whole") as out:
                                for part in [f"{own}/{i}", *[f"{base}/{JOBS}/{job}/{m}/0" for m in more]]:
                                    with there.open_input_stream(part) as piece:
                                        while content := piece.read(1 << 22):
                                            out.write(content)
                            source = f"{own}/whole"
                        else:
                            source = f"{own}/{i}"
                        if there.get_file_info(source).type == fs.FileType.File:  # else moved by an earlier try
                            there.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                            there.move(source, f"{base}/{name}")
                    moved += len(names) - skip
                yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["n"])

        return _tasks(spark, tasks).mapInArrow(move, "n long").agg(F.sum("n")).first()[0]
    finally:
        remove_job(folder, job)


def _chunks(system, paths: Sequence[str]) -> Iterator[bytes]:
    for path in paths:
        with system.open_input_stream(path) as piece:
            while content := piece.read(1 << 22):
                yield content


def write_archives(pieces: DataFrame, folder: str) -> DataFrame:
    """Write the files of ``pieces`` (path, place, seq, line) into ZIP files in ``folder``; returns their names (archive).

    Every file is whole in one archive, under its path, as ``write_files`` would write it. Archives are named after the
    job, so those of an earlier job stay beside them. An archive has at most ``MEMBERS`` files, a long file is written by
    many tasks and packed as a stream. Pieces without a path are left out.
    """
    from pyarrow import fs

    spark = pieces.sparkSession
    job = uuid.uuid4().hex
    try:
        tasks = _written(pieces, folder, job, True)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, base = file_system(folder)
            for batch in batches:
                made = []
                for part, attempt, skip, more in zip(*(c.to_pylist() for c in batch.columns)):
                    own = f"{base}/{JOBS}/{job}/{attempt}"
                    with there.open_input_stream(f"{own}/names") as listed:
                        names = [json.loads(x) for x in listed.read().decode().splitlines()]
                    alone = Archives(there, own, "alone-")
                    for i, name in enumerate(names):
                        if i >= skip:
                            goes_on = [f"{base}/{JOBS}/{job}/{m}/0" for m in more] if i == len(names) - 1 else []
                            whole = [f"{own}/{i}", *goes_on]
                            alone.add(name, _chunks(there, whole), sum(f.size for f in there.get_file_info(whole)))
                    alone.close()
                    # named by their place, so a second try finds what the first has moved
                    for file in there.get_file_info(fs.FileSelector(own)):
                        if file.base_name.endswith(".zip"):
                            there.move(file.path, f"{base}/{job}-{part:05d}-{file.base_name}")
                    made += [f.base_name for f in there.get_file_info(fs.FileSelector(base))
                             if f.base_name.startswith(f"{job}-{part:05d}-")]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

        # a row an archive, of which there are few
        names = [r["archive"] for r in _tasks(spark, tasks).mapInArrow(move, "archive string").collect()] if tasks else []
        return spark.createDataFrame([(n,) for n in names], "archive string").repartition(max(1, len(names)))
    finally:
        remove_job(folder, job)


def archived_files(archives: DataFrame, folder: str, read: Callable[[Iterable[bytes]], Sequence], fields: str) -> DataFrame:
    """(path, ``fields``) of every file in ``archives``; ``read`` gets the content in chunks and returns the fields."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"path string, {fields}")
    arrow = to_arrow_schema(schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_file(f"{root}/{name}") as file, zipfile.ZipFile(file) as archive:
                    for member in archive.infolist():
                        with archive.open(member) as content:
                            rows.append((member.filename, *read(iter(lambda: content.read(1 << 22), b""))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return archives.mapInArrow(look, schema)
