"""Text in blocked gzip, read by many tasks and by contig.

Blocked gzip is a sequence of small gzip members that carry their own size, so reading may begin at any member. The data
source ``contig_lines`` cuts a file into byte ranges; a task finds the first member in its range and reads lines from
there, also the rest of the last one. A filter on the contig is pushed into the source: an index beside the file, either
tabix (``.tbi``) or the contig table of ``write_lines`` (``.contigs``), gives the members that hold the contig, and only
ranges of these are read. A contig that no index knows gives a warning and no rows; a missing file is an error.

A virtual offset is a member's place in the file times 65,536 plus a place in its text.
"""

from __future__ import annotations

import gzip
import struct
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SPLIT_BYTES = 16 << 20
MEMBER_TEXT = 0xFF00
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SUFFIXES = (".gz", ".bgz")
#: Bin number under which tabix keeps counts instead of places.
TABIX_COUNTS = 37450


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a plain path is a local one."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of the blocked gzip files in a folder."""
    system, root = store(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    listed = system.get_file_info(fs.FileSelector(root))
    return sorted((i.path, i.size) for i in listed if i.type == fs.FileType.File and i.path.endswith(SUFFIXES))


def is_blocked(path: str) -> bool:
    """Whether the file (or each file of the folder) begins with a member that carries its size."""
    system, _ = store(path)
    found = files_of(path)
    return bool(found) and all(member_size(system.open_input_file(name).read(64), 0) for name, _ in found)


def member_size(data: bytes, at: int) -> int:
    """Bytes of the member whose header is at ``at``; 0 where there is none."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return 0
    extra, stop = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while extra + 6 <= min(stop, len(data)):
        name, size = data[extra : extra + 2], struct.unpack_from("<H", data, extra + 2)[0]
        if name == b"BC" and size == 2:
            return struct.unpack_from("<H", data, extra + 4)[0] + 1
        extra += 4 + size
    return 0


def member_text(member: bytes) -> bytes:
    text = zlib.decompress(member[12 + struct.unpack_from("<H", member, 10)[0] : -8], -15)
    if zlib.crc32(text) != struct.unpack_from("<I", member, len(member) - 8)[0]:
        raise ValueError("a gzip member does not match its checksum")
    return text


def member(text: bytes) -> bytes:
    squeezer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeezer.compress(text) + squeezer.flush()
    head = MAGIC + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


class Members:
    """The members of a file from a place on."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def _bytes(self, at: int, count: int) -> bytes:
        if not (self.start <= at and at + count <= self.start + len(self.data)):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(count, CHUNK))
        return self.data[at - self.start : at - self.start + count]

    def first(self, begin: int, end: int) -> int | None:
        """Place of the first member that starts in [begin, end): its header is followed by another or by the end."""
        at = begin
        while at < end:
            window = self._bytes(at, min(CHUNK, self.size - at))
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - 3)
                continue
            at += found
            size = member_size(self._bytes(at, min(1 << 16, self.size - at)), 0)
            if at < end and size and (at + size == self.size or self._bytes(at + size, 4) == MAGIC):
                return at
            at += 1
        return None

    def texts(self, at: int) -> Iterator[tuple[int, bytes]]:
        while at < self.size:
            size = member_size(self._bytes(at, min(1 << 16, self.size - at)), 0)
            if not size:
                raise ValueError(f"no gzip member at byte {at}")
            yield at, member_text(self._bytes(at, size))
            at += size


@dataclass
class Range(InputPartition):
    """Members that start in [begin, end); ``skip`` is the place of the first line in the first, None where it is to be found.

    With ``contig`` only its lines count: contigs that share a member have ranges of their own.
    """

    path: str
    size: int
    begin: int
    end: int
    skip: int | None
    contig: str | None = None


def lines_of(part: Range, system: fs.FileSystem) -> Iterator[list[bytes]]:
    """Whole lines that begin in the range, or right behind it; a line is read by one range only."""
    members = Members(system.open_input_file(part.path), part.size)
    at = part.begin if part.skip is not None else members.first(part.begin, part.end)
    if at is None:
        return
    rest, started = b"", False
    for place, text in members.texts(at):
        past = place >= part.end
        if not started:
            if past:
                return
            if part.skip is not None:
                text, started = text[part.skip :], True
            else:  # up to the first line end the text belongs to the range before
                cut = text.find(b"\n")
                if cut < 0:
                    continue
                text, started = text[cut + 1 :], True
        if past:  # finish the last line
            cut = text.find(b"\n")
            if cut >= 0:
                yield [rest + text[:cut]]
                return
            rest += text
            continue
        *whole, rest = (rest + text).split(b"\n")
        if whole:
            yield whole
    if rest:
        yield [rest]


def read_index(system: fs.FileSystem, path: str) -> dict[str, tuple[int, int]] | None:
    """Contig to (first, last) virtual offsets; None without an index."""
    for suffix, parse in ((".contigs", _contig_table), (".tbi", _tabix)):
        if system.get_file_info(path + suffix).type == fs.FileType.File:
            return parse(system.open_input_file(path + suffix).read())
    return None


def _contig_table(data: bytes) -> dict[str, tuple[int, int]]:
    return {c: (int(a), int(b)) for c, a, b in (line.split("\t") for line in data.decode().splitlines())}


def _tabix(data: bytes) -> dict[str, tuple[int, int]]:
    data = gzip.decompress(data)
    if data[:4] != b"TBI\x01":
        raise ValueError("no tabix index")
    count, length = struct.unpack_from("<i", data, 4)[0], struct.unpack_from("<i", data, 32)[0]
    names = data[36 : 36 + length].rstrip(b"\0").decode().split("\0")
    at, found = 36 + length, {}
    for name in names[:count]:
        places = []
        bins, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            for chunk in range(chunks):
                if number != TABIX_COUNTS:
                    places.append(struct.unpack_from("<QQ", data, at + 16 * chunk))
            at += 16 * chunks
        at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
        if places:
            found[name] = (min(a for a, _ in places), max(b for _, b in places))
    return found


class ContigReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.contigs: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            if isinstance(wanted, (EqualTo, In)) and wanted.attribute == ("contig",):
                values = {wanted.value} if isinstance(wanted, EqualTo) else set(wanted.value)
                self.contigs = values if self.contigs is None else self.contigs & values
            else:
                yield wanted

    def partitions(self) -> list[Range]:
        system, _ = store(self.path)
        ranges = []
        for name, size in files_of(self.path):
            index = read_index(system, name) if self.contigs is not None else None
            if index is None:
                ranges += self._cut(name, size, 0, size, 0)
                continue
            for contig in sorted(self.contigs & index.keys()):
                first, last = index[contig]
                ranges += self._cut(name, size, first >> 16, min(size, (last >> 16) + 1), first & 0xFFFF, contig)
        return ranges or [Range("", 0, 0, 0, None)]

    def _cut(self, name: str, size: int, begin: int, end: int, skip: int, contig: str | None = None) -> list[Range]:
        edges = [*range(begin, end, self.split_bytes), end]
        return [Range(name, size, a, b, skip if a == begin else None, contig) for a, b in zip(edges, edges[1:])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = store(self.path)
        for lines in lines_of(partition, system):
            values = [line.decode(errors="replace").removesuffix("\r") for line in lines]
            contigs = [None if v.startswith("#") else v.partition("\t")[0] for v in values]
            wanted = {partition.contig} if partition.contig is not None else self.contigs
            if wanted is not None:
                kept = [i for i, c in enumerate(contigs) if c is not None and c in wanted]
                values, contigs = [values[i] for i in kept], [contigs[i] for i in kept]
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(contigs, pa.string()), pa.array(values, pa.string())], names=["contig", "value"])


class ContigLines(DataSource):
    """Lines of blocked gzip files. Options: path (a file or a folder), split_bytes. Header lines have a null contig."""

    @classmethod
    def name(cls) -> str:
        return "contig_lines"

    def schema(self) -> str:
        return "contig string, value string"

    def reader(self, schema) -> ContigReader:
        return ContigReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_lines(spark: SparkSession, path: str, contigs: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(contig, value) of all lines, or of those of the wanted contigs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = files_of(path)  # a missing file fails here, not in the first action
    if contigs is not None:
        system, _ = store(path)
        known = [read_index(system, name) for name, _ in found]
        unknown = set(contigs).difference(*known) if None not in known else set()
        for contig in sorted(unknown):
            warnings.warn(f"the contig {contig!r} does not exist in {path}", stacklevel=2)
    spark.dataSource.register(ContigLines)
    lines = spark.read.format("contig_lines").option("path", path).option("split_bytes", split_bytes).load()
    return lines if contigs is None else lines.where(F.col("contig").isin(contigs))


def header_lines(path: str) -> list[str]:
    """Lines at the start of the (first) file that begin with ``#``; reads no further."""
    system, _ = store(path)
    name, size = files_of(path)[0]
    head = []
    for lines in lines_of(Range(name, size, 0, size, 0), system):
        for line in lines:
            if not line.startswith(b"#"):
                return head
            head.append(line.decode(errors="replace").removesuffix("\r"))
    return head


def split_lines(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame | None:
    """``value`` lines of blocked gzip, by many tasks and of one contig if asked; None for other files and stores only Spark reads."""
    try:
        if not is_blocked(path):
            return None
    except pa.ArrowInvalid:
        return None
    return read_lines(spark, path, None if contig is None else [contig]).select("value")


def write_lines(lines: DataFrame, folder: str, *order: str, header: list[str] = ()) -> None:
    """Write ``value`` sorted by ``contig`` and ``order`` as blocked gzip with a contig table beside each file.

    A file is a range of the order. Every file carries the header lines. Task attempts write a file of their own and
    rename it, so a repeated task leaves one file.
    """
    ranged = lines.repartitionByRange("contig", *order).sortWithinPartitions("contig", *order).select("contig", "value")
    head = "".join(f"{line}\n" for line in header).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():05d}.gz"
        mine = f"{root}/.{context.taskAttemptId()}"
        out, written, text, table, rows = None, 0, bytearray(head), {}, 0

        def flush(least: int) -> None:
            nonlocal out, written
            out = out or system.open_output_stream(mine, compression=None)
            while len(text) > least:
                block = member(bytes(text[:MEMBER_TEXT]))
                out.write(block)
                written += len(block)
                del text[:MEMBER_TEXT]

        for batch in batches:
            for contig, value in zip(batch.column("contig").to_pylist(), batch.column("value").to_pylist()):
                flush(MEMBER_TEXT - 1)
                start = written << 16 | len(text)
                first, _ = table.get(contig, (start, start))
                table[contig] = (first, start)
                text += value.encode() + b"\n"
                rows += 1
        if rows:
            flush(0)
            out.write(END)
            out.close()
            with system.open_output_stream(f"{mine}.contigs", compression=None) as index:
                index.write("".join(f"{c}\t{a}\t{b}\n" for c, (a, b) in table.items() if c is not None).encode())
            system.move(f"{mine}.contigs", f"{name}.contigs")
            system.move(mine, name)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    ranged.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()
