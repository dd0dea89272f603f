"""WARC archives compressed record by record with Zstandard, written and read.

An archive begins with a skippable frame that holds the dictionary for all later frames; then each
record is one frame. Of records with equal payloads one is a ``response`` and the others are
``revisit`` records that refer to it and carry no payload.

Archives are bounded in size and are made and read as binary values (path, content): Spark's own
writers and readers move them (``binaryFile`` reads archives that lie as files), so any store that
Spark reaches will do, and a retried task cannot leave half an archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import table, utf8
from meshwork.plans.scratch import cut

#: First bytes of the skippable frame that holds a dictionary, of any frame, and of a bare dictionary (fixed by the formats).
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
#: Raw bytes of records after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


class WarcError(ValueError):
    """The bytes are not an archive of this format, or a record contradicts its headers."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: object) -> str:
    return "<urn:page:none>" if page is None else f"<urn:page:{page}>"


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(none|-?\d+)>", urn)
    if not m:
        raise WarcError(f"not a page's id: {urn!r}")
    return None if m[1] == "none" else int(m[1])


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit's block keeps the HTTP head, with the full payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block += b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page)),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def pack(records: list[bytes], level: int = 3) -> bytes:
    """An archive of these records: a dictionary trained on them (none if they are too few), then a frame for each."""
    import zstandard as zstd

    trained = b""
    if len(records) >= 8:
        step = max(1, len(records) // 256)
        try:
            trained = zstd.train_dictionary(DICT_BYTES, [r[:8192] for r in records[::step]]).as_bytes()
        except zstd.ZstdError:
            trained = b""
    press = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_checksum=True)
    held = zstd.ZstdCompressor(level=level).compress(trained) if trained else b""
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *map(press.compress, records)])


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one from each frame. The dictionary may itself be compressed or bare."""
    import zstandard as zstd

    view, at, known = memoryview(archive), 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        held = bytes(view[8 : 8 + size])
        if len(held) != size:
            raise WarcError("the dictionary's frame is cut off")
        at = 8 + size
        if held[:4] == FRAME:
            held = zstd.ZstdDecompressor().decompress(held)
        if held and held[:4] != DICTIONARY:
            raise WarcError("the leading frame holds no dictionary")
        known = zstd.ZstdCompressionDict(held) if held else None
    inflate = zstd.ZstdDecompressor(dict_data=known)
    while at < len(view):
        one, out = inflate.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise WarcError("the last frame is cut off")
            piece = view[at : at + _CHUNK]
            try:
                out.append(one.decompress(piece))
            except zstd.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            at += len(piece) - (len(one.unused_data) if one.eof else 0)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, its version, headers and lengths checked."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", version):
        raise WarcError("not a WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block is not as long as Content-Length says")
    block = rest[:-4]
    if fields.get("warc-block-digest", "sha1:" + digest_of(block)) != "sha1:" + digest_of(block):
        raise WarcError("the block does not match its digest")
    return fields, block


def read_record(raw: bytes) -> tuple[int | None, str, int, str, int | None]:
    """page, record type, payload bytes, payload digest, page referred to; a response's payload is held against both."""
    fields, block = parse(raw)
    http, sep, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not sep or not m:
        raise WarcError("no HTTP head")
    kind, size = fields["warc-type"], int(m[1])
    if kind == "response" and (len(payload) != size or digest_of(payload) != said):
        raise WarcError("the payload does not match its length or digest")
    if kind not in ("response", "revisit") or kind == "revisit" and payload:
        raise WarcError(f"unexpected {kind} record")
    return _page(fields["warc-record-id"]), kind, size, said, _page(fields["warc-refers-to"]) if kind == "revisit" else None


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, n_records, content) of ``pages`` (page_id, url, html).

    Payloads are the UTF-8 of html, empty for null. Of equal payloads (by SHA-256) of at least
    ``min_bytes`` bytes, the record with the largest page_id is the response; a null page_id is
    smaller than any, and rows that repeat the largest page_id are all responses. Only page_ids
    and digests are grouped, combined before the shuffle; payloads then meet their group's
    page_id in a join that adaptive execution splits where a payload is very common (the groups
    are a table of their own, or the join would have to keep the aggregation's partitions).
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    first = cut(rows.groupBy("same").agg(F.max("page_id").alias("first")), "first")
    joined = rows.join(first, "same")
    revisit = (F.col("size") >= min_bytes) & F.coalesce(F.col("page_id") < F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull())
    # sha1() of a binary is hex; base32 needs the bytes and is written with the record
    ready = joined.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", F.unhex(F.sha1("payload")).alias("sha1"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            content = pack(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], names=["path", "n_records", "content"])

        for b in batches:
            for page, url, payload, n, sha1, ref, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page, url, payload, n, base64.b32encode(sha1).decode(), ref, again))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    return ready.mapInArrow(run, "path string, n_records bigint, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of archives given as (path, content), such as ``binaryFile`` reads them.

    Every frame, header, length and digest is checked; the first fault fails the read with the archive's path.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = [read_record(r) for r in frames(content.as_py())]
                except (WarcError, UnicodeDecodeError) as e:
                    raise WarcError(f"{path}: {e}") from e
                page, kind, size, said, ref = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(said, pa.string()), pa.array(kind, pa.string()), pa.array(ref, pa.int64())],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return archives.select("path", "content").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(cut(write_archives(table(spark, sf_dir, "pages")), "warc"))


def _base32(digest: str) -> str:
    """SQL for the base32 of a 40-digit hex string: each five bits as one character."""
    bits = f"array_to_string(list_transform(range(1, 41), lambda i: right(bin(('0x' || substr({digest}, i, 1))::INT + 16), 4)), '')"
    return f"array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(0, 5), lambda o: substr({bits}, 5 * k + o + 1, 1)::INT * (16 // power(2, o)::INT)))::INT + 1, 1)), '')"


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(sha1(coalesce(html, ''))) AS digest FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_base32("digest")} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
