"""WARC archives with a two-level capture index.

Archives: every record is a gzip member of a ``.warc.gz`` file, so it can be read by a range request. Of records with one
payload the one with the largest page id is a response; the others are revisits that refer to it and leave the payload
out. The tasks write through pyarrow's file systems (local or shared folders, HDFS, object stores) into the shared
folder that spark.checkpoint.dir names; a file belongs to one task attempt, and only the attempt that succeeds reports it.

Index: captures are sorted by reversed-host key and page id. Runs of ``block_lines`` captures are compressed into blocks,
and a sparse directory holds the first key of each. The directory stays under about ``DIRECTORY`` entries because blocks
grow with the number of captures; so it may be sent to every task.

Reading: a task finds the block of each wanted key by binary search in the directory, blocks are read once by range and
searched by binary search, and records are read by range, file by file in offset order.

Defined cases: null html is an empty payload, and empty payloads are records like any other; a null url has an empty
key; rows with a null page id are responses that nothing refers to; repeated rows with the largest page id of their
payload are all responses; an empty table gives empty archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed, sized_broadcast, slim_batches, utf8, work_folder

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
BLOCK_LINES = 3_000
DIRECTORY = 65_536
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Sort key of a URL: the host's labels from last to first, then port, path and query; no white space."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url.lower(), safe=":/?=&%,;+$@!*'()~.-_#[]")
    labels = ",".join(reversed(host.split(".")))
    path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~.-_")
    query = f"?{quote(parts.query, safe='/?%:@!$&()*+,;=~.-_')}" if parts.query else ""
    return f"{labels}{f':{port}' if port else ''}){path.lower()}{query.lower()}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~.-_')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), HTTP header and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``refers_to``: the response's page id for revisits, else null."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    shared = keyed.select(digest.alias("payload"), "page_id").groupBy("payload").agg(
        F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")
    )
    shared = sized_broadcast(shared.where("n > 1 and response is not null").select("payload", "response"), 100_000)
    joined = keyed.withColumn("digest", digest).join(shared, F.col("digest") == F.col("payload"), "left")
    refers = F.when(F.col("page_id") != F.col("response"), F.col("response"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


INDEX_SCHEMA = "key string, page_id long, file string, offset long, length long"


def line_key(key: str, page_id: int | None) -> str:
    """Keys and page ids in one order: the key, a space (below any character of a key), the id in 20 digits."""
    return f"{key} {'' if page_id is None else format(page_id + (1 << 63), '020d')}"


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of ``pages`` and return where each is: key, page_id, file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = store(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        for batch in slim_batches(batches):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for page_id, url, refers_to, payload in zip(*columns, utf8(batch.column("html"))):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, payload, refers_to), compresslevel=6, mtime=0)
                out.write(member)
                rows.append((surt(url), page_id, name, offset, len(member)))
                offset += len(member)
            if rows:
                yield _batch(rows, ("key", "page_id", "file", "offset", "length"), "slsll")
        if out is not None:
            out.close()

    return checkpointed(roles(pages).mapInArrow(run, INDEX_SCHEMA))


_TYPES = {"s": pa.string(), "l": pa.int64()}


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)], list(names))


@dataclass(frozen=True)
class CaptureIndex:
    """The directory of a capture index; the blocks are in files."""

    folder: str
    first: tuple[str, ...]
    place: tuple[tuple[str, int, int], ...]

    def blocks_of(self, key: str) -> range:
        """Numbers of the blocks that may hold ``key``."""
        return range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key))


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort the captures into compressed blocks and keep their directory."""
    lines = max(block_lines, -(-captures.count() // DIRECTORY))
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = store(folder)
        filesystem.create_dir(root, recursive=True)
        name, offset, out, block, entries = f"{uuid.uuid4().hex}.index", 0, None, [], []

        def flush() -> None:
            nonlocal offset, out
            out = out or filesystem.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(block).encode())
            out.write(data)
            entries.append((block[0].partition("\t")[0], name, offset, len(data)))
            offset += len(data)
            block.clear()

        for batch in batches:
            for key, page_id, file, at, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
                block.append(f"{line_key(key, page_id)}\t{file}\t{at}\t{length}")
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
        yield _batch(entries, ("first", "file", "offset", "length"), "ssll")

    rows = checkpointed(ordered.mapInArrow(run, "first string, file string, offset long, length long")).collect()
    rows.sort(key=lambda r: (r["first"], r["file"], r["offset"]))
    return CaptureIndex(folder, tuple(r["first"] for r in rows), tuple((r["file"], r["offset"], r["length"]) for r in rows))


def read_range(filesystem: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with filesystem.open_input_file(path) as source:
        source.seek(offset)
        return source.read(length)


def lookup(index: CaptureIndex, wanted: DataFrame) -> DataFrame:
    """Captures of the wanted (url, page_id) pairs: line, file, offset, length."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page_id in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist()):
                key = line_key(surt(url), page_id)
                rows += [(block, key) for block in index.blocks_of(key)]
            yield _batch(rows, ("block", "line"), "ls")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = store(index.folder)
        current, keys, lines = -1, [], []
        for batch in batches:
            rows = []
            for block, key in zip(batch.column("block").to_pylist(), batch.column("line").to_pylist()):
                if block != current:
                    file, offset, length = index.place[block]
                    lines = zlib.decompress(read_range(filesystem, f"{root}/{file}", offset, length)).decode().split("\n")
                    keys, current = [line.partition("\t")[0] for line in lines], block
                for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                    _, file, at, length = lines[i].split("\t")
                    rows.append((key, file, int(at), int(length)))
            yield _batch(rows, ("line", "file", "offset", "length"), "ssll")

    asked = wanted.select("url", "page_id").mapInArrow(locate, "block long, line string").distinct()
    grouped = asked.repartition("block").sortWithinPartitions("block", "line")
    return grouped.mapInArrow(search, "line string, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at (file, offset, length): page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from the payload that was read and must agree with its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = store(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, filesystem.open_input_file(f"{root}/{file}")
                source.seek(offset)
                rows.append(_described(gzip.decompress(source.read(length))))
            yield _batch(rows, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "llssl")
        if source is not None:
            source.close()

    # A file is written by one task and has at most FILE_BYTES and a record, so a group of this shuffle is bounded.
    by_file = captures.repartition("file").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _page(identifier: str | None) -> int | None:
    text = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _described(data: bytes) -> tuple:
    fields, http, payload = parse_record(data)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and sha1_base32(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    length = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return _page(fields["warc-record-id"]), length, digest, fields["warc-type"], _page(fields.get("warc-refers-to"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives with an index, look every page up and read its record back."""
    folder = folder or work_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archive")
    index = write_index(captures, f"{folder}/index")
    return read_records(lookup(index, pages), f"{folder}/archive")
