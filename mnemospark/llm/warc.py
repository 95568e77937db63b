"""WARC archives compressed with Zstandard: a writer and a reader.

An archive begins with a skippable frame that holds the dictionary of its frames (itself possibly compressed); then every
record is a frame of its own. The reader takes the dictionary from that frame, decodes frame after frame, and checks each
record: version line, header fields, Content-Length against the block, the record's end, the length that the HTTP header
names, and the digest of the payload. A record that fails raises ValueError.

Tasks make archives as rows (name, content), cut at ``ARCHIVE_BYTES``; ``export`` puts them out as files, and ``read_files``
reads such files through Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16_000_000
REVISIT_FROM = 1000
#: The dictionary is trained on so many pages, of each of which it sees so many characters; it only helps compression.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 16_384, 32_768
CHUNK = 1 << 15


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A Zstandard dictionary from a bounded sample; empty if the sample is too small for one."""
    html = F.substring(F.coalesce(F.col(html_col), F.lit("")), 1, SAMPLE_CHARS)
    drawn = F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE_PAGES / max(1, pages.count())) * (1 << 30))
    rows = pages.select(html.alias("html")).where("html <> ''").where(drawn).orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["html"].encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _record_id(page_id, digest: str) -> str:
    return f"<{uuid.UUID(hex=hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest()).urn}>"


def _safe(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(page_id, url, html: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    digest = hashlib.sha1(html)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if is_revisit else http + html
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest.hexdigest())), ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest.digest()).decode()), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _safe(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest.hexdigest())), ("X-Refers-To-Page-Id", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _write(dictionary: bytes, date: str, prefix: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        made = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        lead = b""
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            lead = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        info = b"software: mnemospark\r\nformat: WARC File Format 1.1\r\n"
        lead += made.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(prefix, 'info')}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
        frames, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to, is_revisit in batch[["page_id", "url", "html", "refers_to", "is_revisit"]].itertuples(index=False, name=None):
                frame = made.compress(_record(None if pd.isna(page_id) else int(page_id), url, bytes(html), None if pd.isna(refers_to) else int(refers_to), bool(is_revisit), date))
                if frames and size + len(frame) > limit:
                    yield pd.DataFrame({"name": [f"{prefix}-{part:06d}-{number:05d}.warc.zst"], "content": [lead + b"".join(frames)]})
                    frames, size, number = [], 0, number + 1
                frames.append(frame)
                size += len(frame)
        if frames:
            yield pd.DataFrame({"name": [f"{prefix}-{part:06d}-{number:05d}.warc.zst"], "content": [lead + b"".join(frames)]})

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", prefix: str = "pages", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives as rows (name, content): a record per row of ``pages``.

    Null html is an empty payload. Of equal payloads of at least ``REVISIT_FROM`` bytes, the record with the largest id is
    a response (each row that repeats this id is one; so are all if no id is known); the others are revisit records
    without a payload that refer to it. Shorter payloads are all responses. A null url leaves the target out. An empty
    table gives no archive.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    long = F.octet_length("html") >= REVISIT_FROM
    keyed = given.where(long).select("*", F.sha1("html").alias("digest"), F.xxhash64("html").alias("second"))
    largest = keyed.groupBy("digest", "second").agg(F.max("page_id").alias("refers_to"))
    known = keyed.join(largest, ["digest", "second"]).select("page_id", "url", "html", "refers_to", (~F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("is_revisit"))
    short = given.where(~long).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("is_revisit"))
    # in order, so that a task that runs again makes the same files
    ordered = known.union(short).sortWithinPartitions("page_id", "url", F.xxhash64("html"))
    return ordered.mapInPandas(_write(train_dictionary(pages, html_col), date, prefix, limit), "name string, content binary")


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one after the other."""
    at, dictionary = 0, None
    view = memoryview(content)
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise ValueError("the dictionary frame is cut off")
        raw, at = content[8 : 8 + size], 8 + size
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(content):
        if content[at : at + 4] != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, parts = reader.decompressobj(), []
        while not one.eof:
            piece = view[at : at + CHUNK]
            if not len(piece):
                raise ValueError("the last frame is cut off")
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as e:
                raise ValueError(f"a frame can't be decoded: {e}") from e
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record, after checks of form and length."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("a record without a WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header line without a colon: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    missing = [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]
    if missing or not fields["content-length"].isdigit():
        raise ValueError(f"a record without {', '.join(missing) or 'a length'}")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} does not match a block of {len(rest) - 4} bytes")
    return fields, rest[:size]


def _page(fields: dict[str, str], block: bytes) -> tuple:
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError("a block without an HTTP header that names a length")
    size, revisit = int(sizes[0]), fields["warc-type"] == "revisit"
    name, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if name != "sha1" or len(digest) != 32:
        raise ValueError("a record without a SHA-1 payload digest")
    digest = base64.b32decode(digest)
    if payload if revisit else len(payload) != size or hashlib.sha1(payload).digest() != digest:
        raise ValueError("a payload that its header does not describe")
    number = lambda x: int(fields[x]) if x in fields else None
    return number("x-page-id"), fields.get("warc-target-uri"), None if revisit else payload, size, digest.hex(), fields["warc-type"], number("x-refers-to-page-id")


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    whole = {"page_id": "Int64", "refers_to": "Int64"}
    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for data in frames(bytes(content)):
                fields, block = parse_record(data)
                if fields["warc-type"] in ("response", "revisit"):
                    rows.append(_page(fields, block))
                    size += len(data)
                    if size > 8_000_000:
                        yield pd.DataFrame(rows, columns=names).astype(whole)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype(whole)


def read_archives(archives: DataFrame) -> DataFrame:
    """The response and revisit records of archives given as rows with a ``content`` column; see ``RECORDS``."""
    return archives.select("content").mapInPandas(_read, RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``*.warc.zst`` files below ``path``, on any store that Spark reads."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path))


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file into ``folder``, a path or address that all executors share; returns (name, size).

    A file is whole when it gets its name, and a task that runs again replaces its own files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(content)
                store.move(part, f"{root}/{name}")
            yield pd.DataFrame({"name": batch["name"], "size": [len(x) for x in batch["content"]]})

    return archives.mapInPandas(run, "name string, size long")
