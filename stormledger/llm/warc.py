"""WARC archives, Zstandard-compressed with a dictionary of their own.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from records of the same
archive; after it each record is one Zstandard frame, compressed with that dictionary. Pages whose payload another page
has already are written as revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from contextlib import ExitStack
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, slices, texts
from .storage import committed, reading

SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records that a dictionary is built from (the archive's first), bytes of the dictionary, Zstandard's level.
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 20, 32 << 10, 3
#: Bytes of records, before compression, after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; where the samples are too few to train on, their last bytes; None where there are hardly any."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, size: int, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit, whose HTTP header still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[5:5] = [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes records to ``<base>-NNN.warc.zst``: holds an archive's first records until its dictionary is built."""

    def __init__(self, base: str):
        self.base, self.stack, self.done = base, ExitStack(), []
        self.held: list[bytes] = []
        self.out = None
        self.size = self.records = 0

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        self.records += 1
        if self.out is None:
            self.held.append(raw)
            if self.size >= SAMPLE_BYTES:
                self.open()
        else:
            self.out.write(self.compressor.compress(raw))
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def open(self) -> None:
        self.uri = f"{self.base}-{len(self.done):03d}.warc.zst"
        self.out = self.stack.enter_context(committed(self.uri))
        dictionary = build_dictionary(self.held)
        raw = dictionary.as_bytes() if dictionary else b""
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        for raw in self.held:
            self.out.write(self.compressor.compress(raw))
        self.held = []

    def close(self) -> None:
        if not self.records:
            return
        if self.out is None:
            self.open()
        self.stack.close()
        self.done.append((self.uri, self.records))
        self.out, self.size, self.records = None, 0, 0


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record of an archive, as a stream."""
    with reading(uri) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri}: no dictionary frame")
        raw = f.read(size)
        # A trained dictionary has a magic number; other bytes are content as they are.
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
        expander = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        with expander.stream_reader(f, read_across_frames=True, closefd=False) as stream:
            kept = bytearray()

            def fill(until: int) -> bool:
                while len(kept) < until:
                    more = stream.read(max(1 << 16, until - len(kept)))
                    if not more:
                        return False
                    kept.extend(more)
                return True

            while fill(1):
                while (end := kept.find(b"\r\n\r\n")) < 0:
                    if not fill(len(kept) + 1):
                        raise ValueError(f"{uri}: a record's header ends early")
                lines = kept[:end].decode().split("\r\n")
                head = dict(line.split(": ", 1) for line in lines[1:])
                stop = end + 4 + int(head["Content-Length"])
                if not fill(stop + 4):
                    raise ValueError(f"{uri}: a record's block ends early")
                yield head, bytes(kept[end + 4 : stop])
                del kept[: stop + 4]


def with_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page with its payload's size and digest and, as ``first_id``, the smallest id of the pages with that payload.

    Payloads meet their first page by a join on the digest; the pages of a frequent payload are split by adaptive execution.
    """
    html = F.coalesce(pages[html_col], F.lit(""))
    p = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("digest"))
    first = p.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    return p.join(first, "digest", "left")


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write a record for each page; one row for each archive: ``archive`` (its URI) and ``n_records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(f"{out}/part-{TaskContext.get().partitionId():06d}")
        with writer.stack:
            for batch in slices(batches):
                ids, urls, first = (batch.column(i).to_pylist() for i in (0, 1, 3))
                for page_id, url, html, first_id in zip(ids, urls, texts(batch.column(2)), first, strict=True):
                    payload = html.encode()
                    again = first_id is not None and page_id != first_id
                    writer.add(record("revisit" if again else "response", page_id, url, base32_digest(payload), payload, len(payload), first_id if again else None))
            writer.close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([u for u, _ in writer.done], pa.string()), "n_records": pa.array([n for _, n in writer.done], pa.int64())})

    rows = with_roles(pages, min_bytes, **columns).select("page_id", "url", "html", "first_id").sortWithinPartitions("page_id")
    return cut(rows.mapInArrow(run, "archive string, n_records long"))


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of all archives, one archive to a task at a time.

    Columns: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``. The digest of a response is taken
    from the payload as read and must agree with the header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows: dict[str, list] = {"page_id": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}
                for head, block in read_records(uri):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and base32_digest(payload) != told:
                        raise ValueError(f"{uri}: {head['WARC-Record-ID']} has another digest")
                    rows["page_id"].append(_page(head["WARC-Record-ID"]))
                    rows["payload_bytes"].append(len(payload) if kind == "response" else int(http.rpartition(b": ")[2]))
                    rows["payload_digest"].append(told)
                    rows["record_type"].append(kind)
                    rows["refers_to"].append(_page(head.get("WARC-Refers-To")))
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, out: str | None = None, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write a WARC record for every page, then read the archives back; one row per row of ``pages``.

    Of pages with equal payloads of at least ``min_bytes`` the one with the smallest id is the response and the others
    revisit it; repeated rows with that id are all responses, and so are smaller payloads. Null html is the empty
    payload, a null url an empty one. A page without an id revisits the group's first that has one; in groups without
    ids all are responses. Other columns are ignored; no pages give no archives.
    """
    return read_archives(write_archives(pages, out or fresh_dir(pages.sparkSession, "warc"), min_bytes, **columns))
