"""WARC: monolithic gzip files turned into record-wise ones, with an offset index.

A WARC that was gzipped as a whole can only be read from its start.  The
normaliser inflates such a stream once, front to back, and writes every record
as a gzip member of its own, so that each can be fetched by offset and length.
The offsets go to a sidecar beside the new file and to the returned table.

One task takes one file at a time and holds a chunk of it; records of any size
pass through in pieces.  Files are listed by Spark's ``binaryFile`` source, which
balances tasks by file size, without reading the content column.  Output is
written under a name of the attempt and then moved to its own name; a task that
runs again after a lost executor gives the same bytes.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
GZIP = 31  # zlib window bits that mean a gzip header
END = b"\r\n\r\n"
_FIRST_LINE = re.compile(rb"WARC/[0-9]\.[0-9]{1,2}\r\n")
_LONGEST_LINE = 16

INDEX_SCHEMA = (
    "file string, number int, offset bigint, length bigint, record_type string, record_id string, uri string, "
    "block_bytes bigint, complete boolean, error string"
)
_INDEX_TYPES = (
    pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(),
)
_INDEX_NAMES = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or a plain absolute path."""
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def record_header(kind: str, record_id: str, uri: str | None, length: int, content_type: str) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        # Control characters would end the line: they are percent-encoded.
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines += [f"Content-Type: {content_type}", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END


def parse_header(raw: bytes) -> dict[str, str]:
    """Fields of a record header by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out.setdefault(name, value.strip())
    return out


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Inflated pieces of a gzip stream of one or more members, about CHUNK each."""
    d, started = zlib.decompressobj(GZIP), False
    while data := read(CHUNK):
        while data:
            if not started:
                data = data.lstrip(b"\0")  # padding between members
                if not data:
                    break
            started = True
            piece = d.decompress(data, CHUNK)
            if piece:
                yield piece
            if d.eof:
                data, d, started = d.unused_data, zlib.decompressobj(GZIP), False
            else:
                data = d.unconsumed_tail
    if started:
        if piece := d.flush():  # what the length limit held back
            yield piece
        if not d.eof:
            raise EOFError("the gzip stream ends early")


@dataclass
class Buffer:
    """Bytes of a stream of pieces, taken by length or up to a mark."""

    pieces: Iterator[bytes]
    held: bytearray = field(default_factory=bytearray)
    error: str | None = None

    def more(self) -> bool:
        if self.error is None:
            try:
                self.held += next(self.pieces)
                return True
            except StopIteration:
                self.error = ""
            except (zlib.error, EOFError, OSError) as e:
                self.error = f"{type(e).__name__}: {e}"
        return False

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def to_record(self) -> int:
        """Drop bytes up to the next first line of a header; how many weren't line ends.

        At the end of the stream nothing is held any more.  Whatever the length of
        what is dropped, a chunk of it is held at a time.
        """
        dropped = 0
        while True:
            found = _FIRST_LINE.search(self.held)
            ended = False
            if not found and len(self.held) < CHUNK:
                if self.more():
                    continue
                ended = True
            keep = found.start() if found else len(self.held) if ended else len(self.held) - _LONGEST_LINE
            gone = self.take(keep)
            dropped += len(gone) - gone.count(b"\r") - gone.count(b"\n")
            if found or ended:
                return dropped

    def header(self, most: int) -> bytes | None:
        """Up to and with the empty line; None where the stream ends first or it is over ``most`` bytes."""
        seen = 0
        while True:
            at = self.held.find(END, seen)
            if at >= 0:
                return self.take(at + len(END))
            seen = max(0, len(self.held) - len(END))
            if len(self.held) > most or not self.more():
                return None


def rewrite(pieces: Iterator[bytes], write: Callable[[bytes], object], level: int, longest_header: int = 64 << 20) -> Iterator[tuple]:
    """Write each record as a member; yields its index fields without the file.

    A record that the stream's damage cuts short keeps what was there and is
    marked incomplete.  Bytes that belong to no record give a row with ``error``
    and no offset, and the search goes on to the next first line of a header: one
    bad header costs no record behind it.  A header must be held to be
    read; one over ``longest_header`` bytes counts as bad.
    """
    buf, at, number = Buffer(pieces), 0, 0
    bad = lambda what: (number, None, None, None, None, None, None, False, what)
    while True:
        if lost := buf.to_record():
            yield bad(buf.error or ("no record header" if not (number or buf.held) else f"{lost} bytes of no record"))
            number += 1
        elif buf.error:
            yield bad(buf.error)
        if not buf.held:
            return
        head = buf.header(longest_header)
        fields = parse_header(head) if head is not None else {}
        size = fields.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            if head is not None:
                buf.held[:0] = head  # another first line may stand further on in it
            buf.take(len(_FIRST_LINE.match(buf.held)[0]))
            yield bad(buf.error or "no record header")
            number += 1
            continue
        z, start, left = zlib.compressobj(level, zlib.DEFLATED, GZIP), at, int(size)
        at += write(z.compress(head))
        while left and (buf.held or buf.more()):
            piece = buf.take(min(left, CHUNK))
            left -= len(piece)
            at += write(z.compress(piece))
        at += write(z.compress(END) + z.flush())
        record_id = fields.get("warc-record-id", "").strip("<>") or None
        yield (
            number, start, at - start, fields.get("warc-type"), record_id, fields.get("warc-target-uri"),
            int(size) - left, not left, None,
        )
        number += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_INDEX_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _INDEX_TYPES)], _INDEX_NAMES)


def _index_line(row: tuple) -> bytes:
    clean = lambda v: "-" if v is None else re.sub(r"\s", "%20", str(v))
    return (" ".join(clean(v) for v in row[1:9]) + "\n").encode("utf-8", "surrogatepass")


def normalise(
    spark: SparkSession, source: str, target: str, *, glob: str = "*.gz", level: int = 6, rows_a_batch: int = 4096
) -> DataFrame:
    """Rewrite all files of the folder ``source`` into ``target``; the index table.

    Each ``name.gz`` becomes ``target/name.gz`` with the sidecar ``name.gz.idx``:
    a line a record with number, offset, length, type, id, URI, block length and
    whether it is complete.  The work is done when the returned table is read, so
    write it once and use what was written.  Members already written singly stay
    so.  Files of one name in different folders below ``source`` would collide:
    only the folder itself is listed.  No file gives an empty table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, root = locate(target)
        out_fs.create_dir(root, recursive=True)
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.rsplit("/", 1)[1]
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                in_fs, inner = locate(path)
                with (
                    in_fs.open_input_stream(inner, compression=None) as src,
                    out_fs.open_output_stream(draft, compression=None) as out,
                    out_fs.open_output_stream(draft + ".idx", compression=None) as idx,
                ):
                    rows: list[tuple] = []
                    for row in rewrite(inflate(src.read), out.write, level):
                        rows.append((f"{target}/{name}", *row))
                        idx.write(_index_line(rows[-1]))
                        if len(rows) == rows_a_batch:
                            yield _batch(rows)
                            rows = []
                out_fs.move(draft, f"{root}/{name}")
                out_fs.move(draft + ".idx", f"{root}/{name}.idx")
                yield _batch(rows)

    return files.mapInArrow(run, INDEX_SCHEMA)


def read_records(index: DataFrame) -> DataFrame:
    """(record_id, uri, complete, block) fetched by offset, each from its own member.

    Rows of the index without an offset are left out.  A range that isn't exactly
    one gzip member with one record fails the job: the index would be wrong.
    """
    wanted = index.where("offset is not null").select("file", "offset", "length", "complete")
    wanted = wanted.repartition("file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, src = None, None
        types = (pa.string(), pa.string(), pa.bool_(), pa.binary())
        names = ["record_id", "uri", "complete", "block"]
        for b in batches:
            rows, held = [], 0
            for file, offset, length, complete in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if src is not None:
                        src.close()
                    in_fs, inner = locate(file)
                    name, src = file, in_fs.open_input_file(inner)
                d = zlib.decompressobj(GZIP)
                raw = d.decompress(src.read_at(length, offset))
                at = raw.find(END) + len(END)
                if not d.eof or d.unused_data or not raw.startswith(b"WARC/"):
                    raise ValueError(f"{file} at {offset}: not one record")
                fields = parse_header(raw[:at])
                rows.append((fields.get("warc-record-id", "").strip("<>") or None, fields.get("warc-target-uri"), complete, raw[at : -len(END)]))
                held += len(raw)
                if held > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if src is not None:
            src.close()

    return wanted.mapInArrow(run, "record_id string, uri string, complete boolean, block binary")


def export_monolithic(
    pages: DataFrame,
    target: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    file_bytes: int = 256 << 20,
    level: int = 1,
) -> DataFrame:
    """(file, records): pages written as WARC files gzipped as a whole.

    A partition writes one stream after the other, each begun with a warcinfo
    record and ended once it holds ``file_bytes``.  A null body is an empty block,
    a null URL leaves out the URI, a null id leaves the record id's number out;
    repeated rows are repeated records.  As with ``normalise``, write the returned
    table once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = locate(target)
        fs.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        out = z = None
        size = count = 0
        info = b"software: gleanery\r\n"

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            name = f"part-{part:06d}-{number:04d}.warc.gz"
            fs.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}"]), pa.array([count], pa.int64())], ["file", "records"])

        for b in batches:
            for i, url, body in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    draft = f"{root}/.{uuid.uuid4().hex}"
                    out, z, size, count = fs.open_output_stream(draft, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                    out.write(z.compress(record_header("warcinfo", f"urn:info:{part}-{number}", None, len(info), "application/warc-fields") + info + END))
                block = (body or "").encode("utf-8", "surrogatepass")
                row_id = "urn:row:" + ("" if i is None else str(i))
                out.write(z.compress(record_header("resource", row_id, url, len(block), "text/html") + block + END))
                size, count = size + len(block), count + 1
                if size >= file_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[body_col].alias("body"))
    return src.mapInArrow(run, "file string, records bigint")


def pages_through_warc(pages: DataFrame, folder: str, *, materialise: Callable[[DataFrame, str], DataFrame], **columns) -> DataFrame:
    """(id, url, n_bytes, payload_md5, complete): every page, read back by offset.

    The pages are written as monolithic files below ``folder``, normalised there,
    and fetched again record by record through the index.
    """
    spark, id_col = pages.sparkSession, columns.get("id_col", "page_id")
    fs, inner = locate(f"{folder}/whole")
    fs.create_dir(inner, recursive=True)  # no page leaves no file, but a folder
    materialise(export_monolithic(pages, f"{folder}/whole", **columns), "warc-files")
    index = materialise(normalise(spark, f"{folder}/whole", f"{folder}/by-record"), "warc-index")
    got = read_records(index.where("record_type = 'resource' or error is not null"))
    number = F.regexp_extract("record_id", r"^urn:row:(-?[0-9]+)$", 1)
    return got.select(
        F.when(number != "", number).cast("bigint").alias(id_col),
        F.col("uri").alias("url"),
        F.octet_length("block").cast("bigint").alias("n_bytes"),
        F.md5("block").alias("payload_md5"),
        "complete",
    )


ORACLE = """
SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS n_bytes, md5(coalesce(html, '')) AS payload_md5, true AS complete
FROM pages
"""
