"""WARC archives: writing, normalising monolithic gzip files, and reading through an offset index.

``write_monolithic`` puts the records of each partition into one gzip stream a file. Such a file has
to be inflated from its start to reach any record. ``normalise`` inflates the stream once and writes
every record again as a gzip member of its own, with a sidecar index of offsets; ``read_archives``
then reads members one by one by the index. Files go through ``pyarrow.fs`` to the folder that the
cluster shares, under the names of their partition, by way of a temporary name, so that a task that
runs again writes the same file.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only, width

LEVEL = 1
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, record_id string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _identifier(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(identifier: str | None) -> int | None:
    name = identifier[len("<urn:page:") : -1] if identifier else "null"
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP headers alone, with the length of the full
    payload in them, and the digest of the full payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_identifier(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_identifier(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Records:
    """Cuts a stream of WARC bytes into records by their Content-Length."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.buffer += data
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) >= 0:
            size = int(_header(bytes(self.buffer[at:end]), b"Content-Length"))
            stop = end + 4 + size + 4
            if len(self.buffer) < stop:
                break
            yield bytes(self.buffer[at:stop])
            at = stop
        del self.buffer[:at]

    def close(self) -> None:
        if self.buffer:
            raise ValueError(f"{len(self.buffer)} bytes after the last whole record")


def _header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        key, found, value = line.partition(b":")
        if found and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "surrogatepass")
    return None


def parse(data: bytes) -> dict:
    """The fields of ``RECORD`` from one record. The digest of a response is computed from its
    payload and must agree with its header."""
    head, _, block = data[:-4].partition(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = _header(head, b"WARC-Payload-Digest").removeprefix("sha1:")
    kind = _header(head, b"WARC-Type")
    size = int(_header(http, b"Content-Length"))
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged payload in {_header(head, b'WARC-Record-ID')}")
    url = _header(head, b"WARC-Target-URI")
    return {
        "page_id": _page(_header(head, b"WARC-Record-ID")),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(_header(head, b"WARC-Refers-To")),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": payload,
    }


def _commit(fs, temporary: str, final: str) -> None:
    if fs.get_file_info(final).type.name != "NotFound":
        fs.delete_file(final)
    fs.move(temporary, final)


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat a payload of at least ``min_bytes``.

    Of equal payloads the row with the largest page_id stands; rows that repeat that page_id stand
    too. Only digests are grouped, by sums made before the shuffle.
    """
    keys = pages.filter(F.length(_payload()) >= min_bytes).select("page_id", F.sha1(_payload()).alias("digest"))
    last = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).filter("first <> refers_to").drop("first")
    return keys.join(last, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_monolithic(pages: DataFrame, repeats: DataFrame, folder: str) -> DataFrame:
    """Writes the records of each partition as one gzip stream; file, n_records of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _filesystem(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs.create_dir(at)
        temporary, final = f"{at}/.{part:06d}.{attempt}", f"{at}/{part:06d}.warc.gz"
        n, gzip = 0, zlib.compressobj(LEVEL, wbits=31)
        with fs.open_output_stream(temporary) as out:
            for b in batches:
                for page, url, payload, refers_to in zip(*(c.to_pylist() for c in (b["page_id"], b["url"])), b["payload"], b["refers_to"].to_pylist(), strict=True):
                    out.write(gzip.compress(record(page, url, payload.as_py(), refers_to, refers_to is not None)))
                    n += 1
            out.write(gzip.flush())
        _commit(fs, temporary, final)
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{part:06d}.warc.gz"], "n_records": [n]})

    rows = pages.withColumn("payload", _payload()).withColumn("digest", F.sha1("payload")).join(repeats, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    return rows.mapInArrow(run, "file string, n_records long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each monolithic ``file`` member by member into ``folder``; the index (``INDEX``),
    which also lies beside each file as ``.idx``. Memory holds one chunk and one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b["file"].to_pylist():
                yield _normalise(file, folder, TaskContext.get().taskAttemptId())

    return files.mapInArrow(run, INDEX)


def _normalise(file: str, folder: str, attempt: int) -> pa.RecordBatch:
    source, path = _filesystem(file)
    fs, at = _filesystem(folder)
    fs.create_dir(at)
    name = os.path.basename(path)
    temporary = f"{at}/.{name}.{attempt}"
    ids, offsets, lengths = [], [], []
    cutter, inflate, offset = Records(), zlib.decompressobj(wbits=47), 0
    with source.open_input_stream(path, compression=None) as data, fs.open_output_stream(temporary, compression=None) as out:

        def put(found: Iterator[bytes]) -> None:
            nonlocal offset
            for r in found:
                gzip = zlib.compressobj(LEVEL, wbits=31)
                member = gzip.compress(r) + gzip.flush()
                out.write(member)
                ids.append(_header(r[: r.find(b"\r\n\r\n")], b"WARC-Record-ID"))
                offsets.append(offset)
                lengths.append(len(member))
                offset += len(member)

        while chunk := data.read(CHUNK):
            while chunk:
                put(cutter.feed(inflate.decompress(chunk, CHUNK)))
                chunk = inflate.unconsumed_tail
                if inflate.eof:  # a source may be members already
                    chunk, inflate = inflate.unused_data, zlib.decompressobj(wbits=47)
        put(cutter.feed(inflate.flush()))
        cutter.close()
    _commit(fs, temporary, f"{at}/{name}")
    with fs.open_output_stream(f"{temporary}.idx") as out:
        out.write("".join(f"{i}\t{o}\t{n}\n" for i, o, n in zip(ids, offsets, lengths, strict=True)).encode())
    _commit(fs, f"{temporary}.idx", f"{at}/{name}.idx")
    kinds = {"file": pa.string(), "record_id": pa.string(), "offset": pa.int64(), "length": pa.int64()}  # named: a file may hold no record
    columns = ([f"{folder}/{name}"] * len(ids), ids, offsets, lengths)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """``RECORD`` (and payload) of every record that the index lists, each read by its own offset.

    A damaged record raises; an empty index gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads
        name, data = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(b["file"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist(), strict=True):
                if file != name:
                    if data:
                        data.close()
                    fs, at = _filesystem(file)
                    name, data = file, fs.open_input_file(at)
                rows.append(parse(zlib.decompress(data.read_at(length, offset), wbits=31)))
            kinds = [pa.string() if n in ("payload_digest", "record_type", "url") else pa.binary() if n == "payload" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
        if data:
            data.close()

    return index.mapInArrow(run, RECORD + ", payload binary" * payloads)


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html), normalises the files and reads them back: ``RECORD``.

    A null html is an empty payload; a null url has no target. A row with a null page_id is a
    response unless its payload is that of a row with an id. Repeated rows have a record each. An
    empty table gives no rows. Other columns are ignored.
    """
    pages = only(pages, page_id="long", url="string", html="string")
    scratch = Scratch(spark, "warc")
    repeats = scratch.table(revisits(pages, min_bytes), "revisits")
    files = scratch.table(write_monolithic(pages, repeats, scratch.path("monolithic")), "files")
    files = files.select("file").repartition(width(spark), "file")
    index = scratch.table(normalise(files, scratch.path("archives")), "index")
    return read_archives(index)
