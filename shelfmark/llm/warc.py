"""WARC archives: per-record gzip members written by Spark, and a reader that salvages."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FEED = 1 << 16  # packed bytes that are unpacked at a time
PIECE = 1 << 20  # unpacked bytes that are made at a time
HELD = 8 << 20  # members up to this size are unpacked once, others once to check and once to read
VERSION_MOST = 32  # bytes of a version line
HEADER_MOST = 1 << 20  # bytes of a header within a member
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """One complete gzip member, the same bytes for the same data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _one_line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(key: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit that holds the header of the response alone.

    The key is in the record's id. The payload's digest and length are those of the full
    payload in both types.
    """
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
        + str(len(payload)).encode() + b"\r\n\r\n"
    )
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{key}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url) if url else f"urn:x-page:{key}"),
        ("WARC-Payload-Digest", sha1_label(payload)),
        ("WARC-Block-Digest", sha1_label(block)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _payload_facts(html: str) -> tuple[Column, Column]:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return F.unhex(F.sha1(payload)).alias("_sha1"), F.octet_length(payload).alias("_length")


def mark_revisits(pages: DataFrame, key: str, html: str, at_least: int = 1000) -> DataFrame:
    """(key, _sha1, _length, refers_to) of the payloads that another record with a larger key has too.

    Of equal payloads of ``at_least`` bytes the largest key is kept. Only keys, lengths and
    digests are shuffled, combined before; a payload with very many copies is an ordinary
    skewed join, which Spark splits.
    """
    facts = pages.select(F.col(key).alias("_key"), *_payload_facts(html)).filter(F.col("_length") >= at_least)
    facts = stored(facts, "warc-digests")
    chosen = (
        facts.groupBy("_sha1", "_length")
        .agg(F.max("_key").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1).drop("_n")
    )
    return facts.join(chosen, ["_sha1", "_length"]).filter(F.col("_key") < F.col("refers_to")).select(
        F.col("_key").cast("long").alias(key), "_sha1", "_length", "refers_to"
    ).distinct()


def write_warc(
    pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2025-01-01T00:00:00Z", at_least: int = 1000, records_per_file: int = 2000,
) -> None:
    """Write every page as a WARC record in its own gzip member, below ``path``.

    Spark's writer commits the files, so lost executors leave no half file and any file
    system that Spark writes to will do. Members end in a zero byte (the highest byte of the
    length), which is given to the writer as its line end; the few that do not are followed
    by an empty member. A null html is an empty payload; repeated keys give a record each,
    and only a smaller key revisits a larger one.
    """
    revisits = mark_revisits(pages, key, html, at_least)
    rows = pages.select(
        F.col(key).cast("long").alias(key), F.col(url).alias("_url"), F.col(html).alias("_html"), *_payload_facts(html)
    )
    # By payload too: a repeated key may have several, each with a target of its own or none.
    rows = rows.join(revisits, [key, "_sha1", "_length"], "left").select(key, "_url", "_html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = gzip_member(b"")
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                members = []
                for k, u, h, r in zip(*(c.slice(lo, 64).to_pylist() for c in batch.columns)):
                    member = gzip_member(build_record(k, u, (h or "").encode("utf-8", "surrogatepass"), r, date))
                    if member[-1]:
                        member += nothing
                    members.append(member[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary")
    (
        members.select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", "\x00").option("compression", "none")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


class _Short(ValueError):
    """The data ends before the record does."""


class Salvage:
    """Records of one archive, plain or gzip, with the byte ranges that could not be read.

    Whenever a check fails (member checksum, version line, header, length, digest), the
    reader looks for the next member or version line from which a valid record can be read,
    and logs the bytes between as a gap. The same is done within a gzip member, whose bytes
    are unpacked in pieces: what can be read of a damaged one is read, and the whole member
    is a gap besides. A gap within a sound member has the bounds of the member.
    """

    def __init__(self, data: bytes):
        self.data, self.gaps = data, []
        self._end = 0  # of the member unpacked last

    def records(self) -> Iterator[tuple[int, dict, bytes, int]]:
        """(offset, header fields, block, end) of each record; in a member the bounds are the member's."""
        data, at, bad, reason = self.data, 0, None, ""
        while at < len(data):
            if data[at : at + 1] in (b"\x00", b"\r", b"\n") and bad is None:
                at += 1  # padding between records
                continue
            packed = data.startswith(MEMBER, at)
            problem, found = "", iter(())
            if packed:
                problem, pieces, digests = self._look(at)
                end = self._next(at + 1) if problem else self._end
                found = self._within(pieces, None if problem else (at, end), digests)
            else:
                try:
                    record, end = self._record(data, at)
                    found = iter([record])
                except ValueError as fault:
                    problem, end = str(fault), self._next(at + 1)
            first = next(found, None)
            if bad is not None and (first or not problem):
                own = self.gaps[-1:] if packed and self.gaps and self.gaps[-1][0] == at else []
                self.gaps[len(self.gaps) - len(own) :] = [(bad, at, reason), *own]
                bad = None
            if first:
                yield at, *first, end
                for record in found:
                    yield at, *record, end
            if problem and bad is None:
                bad, reason = at, problem
            at = end
        if bad is not None:
            self.gaps.append((bad, len(data), reason))

    def _next(self, at: int) -> int:
        member = self.data.find(MEMBER, at)
        line = _VERSION_LINE.search(self.data, at)
        ends = [p for p in (member, line.start() if line else -1) if p >= 0]
        return min(ends, default=len(self.data))

    def _look(self, at: int) -> tuple[str, Iterator[bytes], bool]:
        """What is wrong with the member, its bytes, and whether its records need a digest.

        A member that is only cut off is right up to there; otherwise the fault may lie in
        any record.
        """
        held, size, problem, digests = [], 0, "", False
        try:
            for piece in self._plain(at):
                size += len(piece)
                if size <= HELD:
                    held.append(piece)
        except (ValueError, zlib.error) as fault:
            problem, digests = str(fault), isinstance(fault, zlib.error)
        return problem, iter(held) if size <= HELD else self._sound_part(at), digests

    def _sound_part(self, at: int) -> Iterator[bytes]:
        try:
            yield from self._plain(at)
        except (ValueError, zlib.error):
            return

    def _plain(self, at: int) -> Iterator[bytes]:
        """The bytes of a member in bounded pieces, all that come before an error too."""
        unpacker, fed = zlib.decompressobj(31), at
        while not unpacker.eof and fed < len(self.data):
            chunk = self.data[fed : fed + FEED]
            fed += len(chunk)
            while chunk and not unpacker.eof:
                before = unpacker.copy()
                try:
                    piece = unpacker.decompress(chunk, PIECE)
                except zlib.error:
                    for i in range(len(chunk)):  # a failing call gives nothing: find the last good byte
                        rest = before.decompress(chunk[i : i + 1])
                        if rest:
                            yield rest
                    raise
                chunk = unpacker.unconsumed_tail
                if piece:
                    yield piece
        while not unpacker.eof and (piece := unpacker.decompress(b"", PIECE)):
            yield piece
        if not unpacker.eof:
            raise ValueError("member cut off")
        self._end = fed - len(unpacker.unused_data)

    def _within(self, pieces: Iterator[bytes], log: tuple[int, int] | None, digests: bool) -> Iterator[tuple]:
        """The records in a member's bytes; what lies between them is a gap with the bounds ``log``."""
        held, at, passed, bad, reason, more = bytearray(), 0, 0, None, "", True

        def gap(end: int) -> None:
            if log is not None:
                self.gaps.append((*log, f"{reason} (bytes {bad} to {end} of the member)"))

        while True:
            if at > PIECE:
                del held[:at]
                passed, at = passed + at, 0
            record, short, fault = None, at >= len(held), ""
            if not short:
                if bad is None and held[at] in b"\x00\r\n":
                    at += 1
                    continue
                try:
                    record, end = self._record(held, at)
                except _Short as problem:
                    short, fault = True, str(problem)
                except ValueError as problem:
                    fault = str(problem)
            if short and more:
                piece = next(pieces, None)
                more = piece is not None
                held += piece or b""
                continue
            if record is not None and digests and not any(
                record[0].get(f"warc-{part}-digest", "").startswith("sha1:") for part in ("block", "payload")
            ):
                record, fault = None, "no digest in a damaged member"
            if record is not None:
                if bad is not None:
                    gap(passed + at)
                    bad = None
                yield record
                at = end
                continue
            if at >= len(held):
                break
            if bad is None:
                bad, reason = passed + at, fault
            at += 1
            while True:
                line = _VERSION_LINE.search(held, at)
                start, line = (line.start() if line else -1), None
                if start >= 0 or not more:
                    at = start if start >= 0 else len(held)
                    break
                at = max(at, len(held) - VERSION_MOST)  # a line may go on in the next piece
                del held[:at]
                passed, at = passed + at, 0
                piece = next(pieces, None)
                more = piece is not None
                held += piece or b""
        if bad is not None:
            gap(passed + len(held))

    @staticmethod
    def _record(data: bytes | bytearray, at: int) -> tuple[tuple[dict, bytes], int]:
        line = _VERSION_LINE.match(data, at)
        if not line:
            raise (_Short if len(data) - at < VERSION_MOST else ValueError)("no version line")
        close = data.find(b"\r\n\r\n", line.end() - 2)
        if close < 0:
            raise (_Short if len(data) - at < HEADER_MOST else ValueError)("header not closed")
        fields = {}
        for text in data[line.end() : close].decode("utf-8", "replace").split("\r\n"):
            name, colon, value = text.partition(":")
            if not colon and text:
                raise ValueError("header line without a colon")
            fields[name.strip().lower()] = value.strip()
        if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
            raise ValueError("no content length")
        start = close + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise (_Short if end + 4 > len(data) else ValueError)("record end not found")
        block = bytes(data[start:end])
        label = fields.get("warc-block-digest", "")
        if label.startswith("sha1:") and label != sha1_label(block):
            raise ValueError("block digest differs")
        return (fields, block), end + 4


SALVAGE_SCHEMA = (
    "file string, offset long, gap_end long, problem string, warc_type string, record_id string, "
    "refers_to string, target_uri string, payload binary, payload_length long, payload_sha1 string"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All readable records below ``path`` and a row for every gap between them.

    Record rows have problem null; gap rows have only file, offset, gap_end and problem.
    ``payload`` is the body behind the HTTP header (null in a revisit, whose
    ``payload_length`` and ``payload_sha1`` are those of the full payload, from its header).
    A response whose payload differs from its payload digest is a gap too. One archive is
    read by one task, so it must stay below Spark's row limit (2 GB); an empty file gives
    no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows_of(name: str, data: bytes) -> Iterator[tuple]:
        reader = Salvage(data)
        told = 0
        for at, fields, block, end in reader.records():
            for start, to, problem in reader.gaps[told:]:
                yield name, start, to, problem, None, None, None, None, None, None, None
            told = len(reader.gaps)
            kind = fields.get("warc-type")
            body, full = None, None
            if kind == "revisit":
                length = fields.get("x-payload-length", "")
                full = int(length) if length.isdigit() else None
                label = fields.get("warc-payload-digest", "")[5:]
                digest = base64.b32decode(label).hex() if len(label) == 32 else None
            else:
                body = block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block
                digest, full = hashlib.sha1(body).hexdigest(), len(body)
                label = fields.get("warc-payload-digest", "")
                if label.startswith("sha1:") and label != sha1_label(body):
                    yield name, at, end, "payload digest differs", None, None, None, None, None, None, None
                    continue
            yield (name, at, None, None, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"),
                   fields.get("warc-target-uri"), body, full, digest)
        for start, end, problem in reader.gaps[told:]:
            yield name, start, end, problem, None, None, None, None, None, None, None

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.binary(), pa.int64(), pa.string()]
    names = [part.split()[0] for part in SALVAGE_SCHEMA.split(", ")]

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for row in rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                    rows.append(row)
                    held += len(row[8] or b"")
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return files.mapInArrow(run, SALVAGE_SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A page without a key has record id ``<urn:x-page:None>`` and comes back with null.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    return records.filter(F.col("problem").isNull()).select(
        number(F.col("record_id")).try_cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.col("payload_sha1").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to")).try_cast("long")).alias("refers_to"),
    )
