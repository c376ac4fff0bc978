"""WARC archives: one gzip member per record, read back one after the other.

The reader decompresses incrementally (no more than READ bytes of an archive and the record at hand are
in memory), frames blocks by Content-Length and verifies block and payload digests. Equal payloads of
LEAST bytes or more are stored once: the record with the largest page id is the response, others are
revisits, whose block keeps the HTTP header with the payload's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import new_path, store

LEAST, SALTS, READ, ROLL = 1000, 32, 1 << 16, 64 << 20
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(value: str | None) -> tuple[str, str] | None:
    """(algorithm, hexadecimal digest) of a labelled digest, which writers give in base 32 or 16; None for what is no such."""
    name, _, digest = (value or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512") or not digest:
        return None
    size = hashlib.new(name).digest_size
    try:
        if len(digest) == 2 * size:
            return name, bytes.fromhex(digest).hex()
        plain = base64.b32decode(digest.upper() + "=" * (-len(digest) % 8))
    except ValueError:
        return None
    return (name, plain.hex()) if len(plain) == size else None


def uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def from_uri(value: str | None) -> int | None:
    """The page's number; None for an empty one, and for identifiers of other writers."""
    number = (value or "").strip().removeprefix("<urn:page:").removesuffix(">")
    return int(number) if re.fullmatch(r"-?[0-9]{1,19}", number) else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", uri(page_id)),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", uri(refers_to))] if revisit else []),
        ("WARC-Payload-Digest", sha1_32(payload)),
        ("WARC-Block-Digest", sha1_32(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + squeeze.flush()


class Damaged(ValueError):
    """An archive that breaks the format or a digest."""


def members(stream) -> Iterator[bytes]:
    """The plain bytes of each gzip member."""
    left = b""
    while True:
        left = left or stream.read(READ)
        if not left:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not left and not (left := stream.read(READ)):
                raise Damaged("the archive ends inside a record")
            try:
                parts.append(inflate.decompress(left))
            except zlib.error as e:
                raise Damaged(f"no gzip member: {e}") from e
            left = inflate.unused_data if inflate.eof else b""
        yield b"".join(parts)


def header(lines: list[str]) -> dict[str, str]:
    """Named fields, by lower-case name; a line that begins with white space goes on with the one before."""
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged(f"no field: {line[:60]!r}")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def checked(data: bytes, digest: str | None, what: str) -> None:
    """Raises Damaged if a digest is there, is of a known kind, and differs."""
    known = hex_digest(digest)
    if known and hashlib.new(known[0], data).hexdigest() != known[1]:
        raise Damaged(f"{what} digest differs")


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """(fields by lower-case name, block) of each record of any writer; raises Damaged where framing or a digest fails. Digests
    are optional in the format, and verified where there are."""
    for plain in members(stream):
        head, sep, rest = plain.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not sep or not first.startswith("WARC/"):
            raise Damaged("no WARC header")
        fields = header(lines)
        if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
            raise Damaged("no Content-Length")
        n = int(fields["content-length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise Damaged("Content-Length does not frame the block")
        checked(block, fields.get("warc-block-digest"), "block")
        if fields.get("warc-type", "").lower() == "response":
            checked(payload_of(fields, block), fields.get("warc-payload-digest"), "payload")
        yield fields, block


def is_http(fields: dict) -> bool:
    return fields.get("content-type", "").lower().replace(" ", "").startswith("application/http")


def payload_of(fields: dict, block: bytes) -> bytes:
    """What follows the HTTP header; of other records the block."""
    return block.partition(b"\r\n\r\n")[2] if is_http(fields) else block


def payload_length(fields: dict, block: bytes) -> int | None:
    """The length of the full payload: of a revisit what its HTTP header says, if it says it."""
    if fields.get("warc-type", "").lower() != "revisit":
        return len(payload_of(fields, block))
    said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", block.partition(b"\r\n\r\n")[0])
    return int(said[1]) if said else None


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def writer(folder: str, roll: int = ROLL):
    """A task writes archives of about roll bytes under names of its own attempt; only files that a
    finished task lists are read, so a lost or repeated task leaves nothing wrong."""

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        stem, n, out, size, count, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, 0, 0, []
        for b in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{stem}-{n:05d}.warc.gz"
                    out, size, count, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, n + 1
                data = record(page_id, url, (html or "").encode("utf-8", "replace"), refers_to, revisit)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return run


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to and revisit. Payloads are counted with a combine
    before the shuffle; the few that are found again meet their pages under a salt, so that one payload
    with a third of all pages is dealt over SALTS tasks."""
    keyed = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("d"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    again = keyed.where(F.col("n") >= LEAST).groupBy("d").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    dealt = again.select(F.col("d").alias("d2"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    both = salted.join(dealt, (F.col("d") == F.col("d2")) & (F.col("salt") == F.col("salt2")), "left")
    revisit = F.col("first").isNotNull() & (F.col("n") >= LEAST) & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return both.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes a record per row of pages (page_id long, url, html) and returns the archives (file,
    records, bytes), written as a table, so that asking again does not write again.

    A null html is an empty payload, a null url an empty one; a null page id is written as an empty
    number and never referred to; rows that share the largest id of a payload are all responses; an
    empty table writes no archive; other columns are not read. A payload of any length is one record, held whole by its task."""
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return store(plan_revisits(picked).mapInArrow(writer(folder, roll), "file string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives (file): page_id (null for identifiers of other writers), url, payload_bytes,
    payload_digest (hexadecimal SHA-1: what the record states, or of the payload where it states none; null for revisits without),
    record_type, refers_to, html (null for revisits), record_id. An archive is read by one task, as a stream; archives are dealt evenly
    over as many tasks."""

    def run(batches):
        fs, base = file_system(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                out, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        kind = fields.get("warc-type", "").lower()
                        full, said = kind != "revisit", hex_digest(fields.get("warc-payload-digest"))
                        payload = payload_of(fields, block) if full else b""
                        digest = said[1] if said and said[0] == "sha1" else hashlib.sha1(payload).hexdigest() if full else None
                        out.append((
                            from_uri(fields.get("warc-record-id")), fields.get("warc-target-uri"), payload_length(fields, block), digest,
                            kind, from_uri(fields.get("warc-refers-to")), payload.decode("utf-8", "replace") if full else None, fields.get("warc-record-id"),
                        ))
                        held += len(block)
                        if held > 1 << 23:
                            yield batch(out)
                            out, held = [], 0
                yield batch(out)

    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html", "record_id"]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, record_id string"
    return archives.select("file").repartition(max(1, archives.count())).mapInArrow(run, schema)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    folder = new_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
