"""Folders of cue files: read in one pass and written back, on any file system.

``read_cues`` goes through Spark's own file source; each file is read and decoded once and
kept in the checkpoint folder while the readers of its format take it.  ``cue_files`` is a
data source of one row per file, whose writer puts every file under a temporary name and
moves all of them when the job commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cuemill.session import cut
from cuemill.sources import registry

CUES = "doc_id long, cue_idx int, start double, duration double, speaker string, text string, path string"
PENDING = "_pending"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def inside(path: str) -> str:
    """A relative path that stays where it is put."""
    parts = PurePosixPath(path).parts
    if not parts or PurePosixPath(path).is_absolute() or ".." in parts or parts[0].startswith("_"):
        raise ValueError(f"not a path inside the folder: {path!r}")
    return "/".join(parts)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CueFiles(DataSource):
    """Files of a folder, one row each: path and decoded content; written back one file a row."""

    @classmethod
    def name(cls) -> str:
        return "cue_files"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def decode(data: bytes) -> str:
    """By byte order mark, else UTF-8, GB 18030, Latin-1."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(charset, "replace")
    for charset in ("utf-8", "gb18030"):
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options.get("path"), options.get("glob", "*")

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.is_file and f"/{PENDING}/" not in f.path and PurePosixPath(f.path).match(self.glob))
        return [_File(n) for n in names] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            with opened(self.path)[0].open_input_stream(partition.path) as stream:
                yield partition.path, decode(stream.read())


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options.get("path"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = opened(self.path)
        here = f"{PENDING}/{self.job}/{uuid.uuid4().hex}"  # of this attempt only
        done = []
        for row in rows:
            name = inside(row.path)
            target = f"{root}/{here}/{name}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as stream:
                stream.write(row.content.encode("utf-8"))
            done.append(f"{here}/{name}")
        return _Written(done)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.base_name != PENDING:
                    (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        for message in messages:
            for path in message.paths if message else ():
                target = f"{root}/{path.split('/', 3)[3]}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                system.move(f"{root}/{path}", target)
        self._clean(system, root)

    def abort(self, messages: list) -> None:
        self._clean(*opened(self.path))

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{PENDING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{PENDING}/{self.job}")
        rest = system.get_file_info(fs.FileSelector(f"{root}/{PENDING}", allow_not_found=True))
        if not rest and system.get_file_info(f"{root}/{PENDING}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{PENDING}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CueFiles)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path: ``path`` and decoded ``content``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if b is None else decode(b) for b in batch.column(1).to_pylist()], pa.string())], ["path", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(work, "path string, content string")


def read_cues(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Cues of all files below a path; the format is detected by content where none is given.

    Result: cues with ``doc_id`` (a number of this read only) and ``path``.
    """
    found = read_documents(spark, path).withColumn("format", F.lit(fmt) if fmt else registry.detect_format(F.col("content")))
    docs = cut(found.withColumn("doc_id", F.monotonically_increasing_id()))
    out = None
    # no more names than there are formats
    for name in [fmt] if fmt else sorted(r[0] for r in docs.select("format").distinct().collect()):
        cues = registry.read(docs.where(F.col("format") == name).select("doc_id", "content"), name).select("doc_id", "cue_idx", "start", "duration", "speaker", "text")
        out = cues if out is None else out.unionByName(cues)
    if out is None:
        return spark.createDataFrame([], CUES)
    return out.join(docs.select("doc_id", "path"), "doc_id")


def write_cues(cues: DataFrame, path: str, fmt: str, overwrite: bool = False) -> None:
    """One file per document, named by its id."""
    register(cues.sparkSession)
    docs = registry.write(cues, fmt)
    named = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(f".{fmt}")).alias("path"), "content")
    named.write.format("cue_files").mode("overwrite" if overwrite else "append").save(path)
