"""Spark data sources of this package: `spark.read.format(...)` over image folders and descriptor records.

    datasource.register(spark)
    spark.read.format("prismet_images").option("pattern", "*.png").load("hdfs://host/folder")
    spark.read.format("prismet_descriptors").load("s3://bucket/desc2025.xml")

Both plan their partitions on the driver from a listing and read files where Spark runs the tasks, through Arrow's file
systems, so a path may name any store that those know (a path without a scheme is local). Descriptor files are cut into ranges of
bytes; a range gives the records that begin in it. Packed files, told by their first two bytes, cannot be cut and are one
range, unpacked a megabyte at a time.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range of descriptor records, of the pieces that it is read in, and of image contents in one partition.
RANGE_BYTES, PIECE_BYTES, PARTITION_BYTES = 32 << 20, 1 << 20, 64 << 20
OPEN, CLOSE = re.compile(rb"<DescriptorRecord[\s>]"), b"</DescriptorRecord>"
LONGEST_TAG = 64


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pa.fs.LocalFileSystem(), path


def listed(path: str, recursive: bool) -> list[pa.fs.FileInfo]:
    """Files of a folder (or the file itself) in order of path; a path that is not there is an error that names it."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path}")
    if info.type == pa.fs.FileType.File:
        return [info]
    found = system.get_file_info(pa.fs.FileSelector(at, recursive=recursive))
    return sorted((f for f in found if f.type == pa.fs.FileType.File and not posixpath.basename(f.path).startswith(("_", "."))), key=lambda f: f.path)


def flag(options, name: str) -> bool:
    return str(options.get(name, "false")).strip().lower() in ("true", "1", "yes")


# --- images


@dataclass
class Files(InputPartition):
    paths: list[str]


class ImageFolder(DataSource):
    """file, path, bytes and, unless `content` is false, content of the files of a folder that fit `pattern`."""

    @classmethod
    def name(cls) -> str:
        return "prismet_images"

    def schema(self) -> str:
        return "file string, path string, bytes long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options)


class ImageReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.recursive, self.content = flag(options, "recursive"), str(options.get("content", "true")).lower() != "false"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        """Files in order of path, so many to a partition that their contents stay below `partitionBytes` (one file at least)."""
        out, held = [Files([])], 0
        for f in listed(self.path, self.recursive):
            if not fnmatch.fnmatchcase(posixpath.basename(f.path), self.pattern):
                continue
            size = f.size + 4096 if self.content else 4096
            if out[-1].paths and held + size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        names = ["file", "path", "bytes", "content"]
        for path in partition.paths:
            size = system.get_file_info(path).size
            content = None
            if self.content:
                with system.open_input_stream(path) as f:
                    content = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([posixpath.basename(path)]), pa.array([path]), pa.array([size], pa.int64()), pa.array([content], pa.binary())], names=names)


# --- descriptor records


@dataclass
class Range(InputPartition):
    """Bytes of a file in which records begin; a packed file is one range."""

    path: str
    number: int
    start: int
    stop: int
    packed: bool


class Descriptors(DataSource):
    """pos, name, trees of descriptor records in the order of files and records; a record without a name is left out."""

    @classmethod
    def name(cls) -> str:
        return "prismet_descriptors"

    def schema(self) -> str:
        return "pos long, name string, trees array<string>"

    def reader(self, schema) -> DataSourceReader:
        return DescriptorReader(self.options)


class DescriptorReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        system, _ = located(self.path)
        out = []
        for number, f in enumerate(listed(self.path, flag({}, "recursive"))):
            with system.open_input_stream(f.path, compression=None) as head:
                packed = head.read(2) == b"\x1f\x8b"
            step = max(1, f.size if packed else self.range_bytes)
            out += [Range(f.path, number, start, min(f.size, start + step), packed) for start in range(0, f.size, step)]
        return out or [Range("", 0, 0, 0, False)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        pieces = self._unpacked(partition) if partition.packed else self._plain(partition)
        for at, record in records(pieces, partition.start, None if partition.packed else partition.stop):
            name, trees = parsed(record)
            if name is not None:
                yield partition.number << 44 | at, name, trees  # a file has fewer than 2**44 bytes

    def _plain(self, r: Range) -> Iterator[bytes]:
        """The file from the range's start on; who reads stops where its last record ends."""
        with located(self.path)[0].open_input_file(r.path) as f:
            f.seek(r.start)
            while piece := f.read(PIECE_BYTES):
                yield piece

    def _unpacked(self, r: Range) -> Iterator[bytes]:
        stream = zlib.decompressobj(31)
        with located(self.path)[0].open_input_stream(r.path, compression=None) as f:
            while piece := f.read(PIECE_BYTES):
                while piece:
                    yield stream.decompress(piece)
                    piece = stream.unused_data  # packed files may be strung together
                    if piece:
                        stream = zlib.decompressobj(31)


def records(pieces: Iterator[bytes], start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(place of the first byte, record) of the records that begin from start on, below stop. A tag that a boundary cuts
    belongs to the range in which it begins."""
    held, place, at = b"", start, 0  # bytes read, the place of the first of them, and how many are used up
    ended = False
    while True:
        m = OPEN.search(held, at)
        if m is None:
            at = max(at, len(held) - LONGEST_TAG)
            if ended or (stop is not None and place + at >= stop):
                return
        elif stop is not None and place + m.start() >= stop:
            return
        else:
            end = held.find(CLOSE, m.start())
            if end >= 0:
                yield place + m.start(), held[m.start() : (at := end + len(CLOSE))]
                continue
            if ended:
                return  # a record that is never closed is none
            at = m.start()
        more = next(pieces, None)
        ended = more is None
        held, place, at = held[at:] + (more or b""), place + at, 0


def parsed(record: bytes) -> tuple[str | None, list[str]]:
    """Name and tree numbers of one record; a missing list of tree numbers is empty."""
    root = ElementTree.fromstring(record)
    name = root.findtext("DescriptorName/String")
    return (None if name is None else name.strip()), [t.text or "" for t in root.findall("TreeNumberList/TreeNumber")]


def register(spark: SparkSession) -> None:
    for source in (ImageFolder, Descriptors):
        spark.dataSource.register(source)
