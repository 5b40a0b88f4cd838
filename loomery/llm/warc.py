"""WARC archives: writing pages, normalising whole-file gzip streams, reading records by offset.

Archives are files below the shared folder, written and read by the tasks
through the file system that the folder's URI names.  A file is written under
a name of its own and then renamed, so nothing is half-written.  A task that
runs again may get its rows in another order and cut them elsewhere, so every
attempt names its archives anew, and the manifest names those that count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, materialize, small_side

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Raw bytes after which a writer starts the next file, and of one read.
ROLL_BYTES, READ_BYTES = 16 << 20, 1 << 18


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^(\w+):/", r"\1:///", uri))


class AtomicFile:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.store, self.path = _open(uri)
        folder, _, name = self.path.rpartition("/")
        self.store.create_dir(folder, recursive=True)
        self.draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.draft, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        # another run over the same source has left the same file: some stores do not move onto it
        if self.store.get_file_info(self.path).type == fs.FileType.File:
            self.store.delete_file(self.draft)
        else:
            self.store.move(self.draft, self.path)


def record(page_id, url: str | None, payload: bytes | None, digest: str, size: int, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that keeps only the response's head."""
    name = "-" if page_id is None else str(page_id)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{name}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(CRLF)[1:]:
        key, _, value = line.partition(b":")
        if key:
            out[key.decode().lower()] = value.strip().decode()
    return out


def parse(data: bytes) -> dict:
    """page_id, type, digest, size, payload and refers_to of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    h = headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    page = h["warc-record-id"][len("<urn:page:") : -1]
    kind = h["warc-type"]
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {h['warc-record-id']} does not have its digest")
    refers = h.get("warc-refers-to")
    return {
        "page_id": None if page == "-" else int(page),
        "payload_bytes": int(headers(http)["content-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
        "payload": payload if kind == "response" else None,
    }


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, size, digest and refers_to: the largest page_id of equal payloads is their response."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", body.alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    copies = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(small_side(materialize(copies, "page-copies")), "digest", "left")
    return rows.withColumn("refers_to", F.when((F.col("size") >= min_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write ``rows`` of :func:`with_revisits` as archives that are one gzip stream each; (path, records).

    Only files of the returned rows, written as a table, count: a lost attempt
    leaves others beside them.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt, files, out = TaskContext.get().partitionId(), uuid.uuid4().hex[:16], 0, None
        raw = n = 0

        def finish() -> pd.DataFrame:
            out.write(stream.flush())
            out.close()
            return pd.DataFrame({"path": [path], "records": [n]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    path = f"{folder}/part-{part:06d}-{files:05d}-{attempt}.warc.gz"
                    out, stream = AtomicFile(path), zlib.compressobj(level, zlib.DEFLATED, 31)
                    files, raw, n = files + 1, 0, 0
                ids = [None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to)]
                data = record(ids[0], r.url if isinstance(r.url, str) else None, r.payload, r.digest, r.size, ids[1])
                out.write(stream.compress(data))
                raw, n = raw + len(data), n + 1
                if raw >= ROLL_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return rows.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInPandas(run, "path string, records long")


def inflated(uri: str) -> Iterator[bytes]:
    """The plain bytes of a gzip file of any number of members, read and inflated once, a piece at a time."""
    store, path = _open(uri)
    with store.open_input_stream(path, compression=None) as source:
        member = zlib.decompressobj(31)
        while data := source.read(READ_BYTES):
            while data:
                piece = member.decompress(data, READ_BYTES)
                if piece:
                    yield piece
                data = member.unconsumed_tail
                if member.eof:
                    data, member = member.unused_data, zlib.decompressobj(31)


def records(uri: str) -> Iterator[bytes]:
    """Whole records of an archive in order, with their blank lines."""
    held = bytearray()
    need = None
    for piece in inflated(uri):
        held += piece
        while True:
            if need is None:
                end = held.find(CRLF + CRLF)
                if end < 0:
                    break
                need = end + 8 + int(headers(bytes(held[:end]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{uri} ends inside a record")


def normalise(manifest: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrite archives with one gzip member per record and a sidecar ``.idx``; the index rows are returned.

    An index row is (path, offset, length, record_type, page_id); the sidecar
    holds the same as tab-separated lines.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["path"]:
                path = f"{folder}/{source.rsplit('/', 1)[1]}"
                out, rows = AtomicFile(path), []
                for data in records(source):
                    h = headers(data[: data.index(CRLF + CRLF)])
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    packed = member.compress(data) + member.flush()
                    rows.append((path, out.at, len(packed), h["warc-type"], h["warc-record-id"]))
                    out.write(packed)
                out.close()
                side = AtomicFile(path + ".idx")
                side.write("".join("\t".join(map(str, r[1:])) + "\n" for r in rows).encode())
                side.close()
                yield pd.DataFrame(rows, columns=["path", "offset", "length", "record_type", "record_id"])

    return manifest.select("path").mapInPandas(run, "path string, offset long, length long, record_type string, record_id string")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that index rows point to, each read and inflated by its own offset."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, group in batch.groupby("path", sort=False):
                store, own = _open(path)
                with store.open_input_file(own) as source:
                    for at in range(0, len(group), 200):
                        found = []
                        for r in group.iloc[at : at + 200].itertuples():
                            source.seek(r.offset)
                            found.append(parse(zlib.decompress(source.read(r.length), 31)))
                        rows = pd.DataFrame(found, columns=columns)
                        for c in ("page_id", "refers_to"):
                            rows[c] = rows[c].astype("Int64")
                        yield rows

    return index.select("path", "offset", "length").mapInPandas(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, normalise them and return the index.

    A null html is an empty payload; a null url gets a name of its own; a
    null page_id is kept and refers as any other, but is never the response
    of copies that have an id; rows that share the largest page_id of their
    payload are all responses; other columns are left out; an empty table
    gives an empty index.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = materialize(write_archives(with_revisits(pages, min_bytes), f"{folder}/whole"), "warc-manifest")
    files = max(1, manifest.count())
    return materialize(normalise(manifest.repartition(files), f"{folder}/members"), "warc-index")
