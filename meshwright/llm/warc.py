"""Legacy ARC archives to WARC, and back to rows.

to_arc() stores pages as ARC archives of version 1 or 2 (one gzip member per record, a version block first). read_arc() parses each
archive by the header fields that its version block names and by the declared lengths. to_warc() synthesises WARC records of the
same captures: a record id and date derived from the capture, SHA-1 payload digests in base 32, type response, or revisit for a
payload that an earlier page has. read_warc() parses the stored archives, recomputes the digests and lengths of responses, follows
the revisits' WARC-Refers-To to the responses' WARC-Record-ID, holds their digests together, and gives one row per page.

Archives are rows (archive, content, pages): a task writes many, each bounded by ARCHIVE_BYTES or one record; pages is the archive's
index, the page id of each record in turn. Payload bytes move between tasks only compressed. Digests are grouped before anything
moves, and only payloads that more than one page has are joined back; an archive asks for a response once, however many of its
records revisit it, so one payload may hold any share of the pages.

Defined cases: null html is an empty payload; a null url becomes that of no host; of rows with the same page id and payload the first
in the archives is the response and the others revisit it; a null page id never is what others refer to unless all captures of a
payload have none; a payload larger than an archive is one of its own; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, text_or_empty, write_table

ARCHIVE_BYTES = 4 << 20
#: Captures carry no time; all get this one (ARC form).
CAPTURED = "20240101000000"
#: The header fields of the two versions of ARC, as their version blocks spell them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-capture")


def member(record: bytes) -> bytes:
    """One gzip member without a time, so equal records give equal bytes."""
    return gzip.compress(record, compresslevel=1, mtime=0)


def members(content: bytes) -> Iterator[bytes]:
    """The records of a file of gzip members."""
    while content:
        reader = zlib.decompressobj(31)
        yield reader.decompress(content)
        content = reader.unused_data


def arc_block(fields: list[str], body: bytes, version: int) -> bytes:
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def arc_archive(name: str, version: int, pages: list[tuple[str | None, bytes]]) -> bytes:
    """An ARC file: the version block, then a block for each page."""
    about = f"{version} {0 if version == 1 else 1} meshwright\n{ARC_FIELDS[version]}\n\n".encode()
    first = [f"filedesc://{name}", "0.0.0.0", CAPTURED, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(about))]
    out = [member(arc_block(first, about, version))]
    at = len(out[0])
    for url, html in pages:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n"
        body = head.encode() + html
        link = "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in (url or "none:").encode())
        more = ["200", "-", "-", str(at), name] if version == 2 else []
        out.append(member(arc_block([link, "0.0.0.0", CAPTURED, "text/html", *more, str(len(body))], body, version)))
        at += len(out[-1])
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each block after the version block, which names the fields."""
    names: list[str] = []
    for record in members(content):
        line, _, rest = record.partition(b"\n")
        values = line.decode().split(" ")
        size = int(values[-1])
        body = rest[:size]
        if len(body) != size or rest[size:] not in (b"\n", b""):
            raise ValueError("an ARC block's length does not hold")
        if not names:
            version, fields, *_ = body.decode().split("\n")
            names = fields.split(" ")
            if ARC_FIELDS.get(int(version.split(" ")[0])) != fields or len(values) != len(names):
                raise ValueError("an ARC version that isn't known")
            continue
        if len(values) != len(names):
            raise ValueError("an ARC header line of another version")
        yield dict(zip(names, values)), body


def split_http(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, header fields and payload of an HTTP response."""
    head, _, payload = body.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return head, fields, payload


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, place: int) -> str:
    """The id of what a legacy archive holds at a place: the same whenever it is made."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}|{place}')}>"


def warc_record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    return member(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))]).encode() + b"\r\n" + body + b"\r\n\r\n")


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for record in members(content):
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
            raise ValueError("a WARC record's length does not hold")
        yield fields, rest[:size]


def arc_to_warc_moment(moment: str) -> str:
    return f"{moment[:4]}-{moment[4:6]}-{moment[6:8]}T{moment[8:10]}:{moment[10:12]}:{moment[12:14]}Z"


def to_arc(pages: DataFrame, identity: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """archive, content, pages: ARC files of both versions by turns."""
    rows = pages.select(F.col(identity).cast("long").alias("page"), F.col(url).cast("string").alias("url"), text_or_empty(html).cast("binary").alias("html"), F.spark_partition_id().alias("task"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for part in slices(batch, 2, ARCHIVE_BYTES):
                name = f"part-{part.column(3)[0].as_py():06d}-{k:06d}.arc.gz"
                content = arc_archive(name, 1 + k % 2, list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))], names=["archive", "content", "pages"])
                k += 1

    return rows.mapInArrow(store, "archive string, content binary, pages array<long>")


def read_arc(archives: DataFrame) -> DataFrame:
    """archive, place, page, url, moment, size, digest, response (the HTTP response, compressed) of each capture."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, pages in zip(*batch.columns):
                pages, urls, moments, sizes, digests, bodies = pages.as_py(), [], [], [], [], []
                for fields, body in parse_arc(content.as_py()):
                    _, _, payload = split_http(body)
                    urls.append(fields["URL"])
                    moments.append(fields["Archive-date"])
                    sizes.append(len(payload))
                    digests.append(digest(payload))
                    bodies.append(zlib.compress(body, 1))
                n = len(urls)
                if n != len(pages):
                    raise ValueError("an archive and its index differ")
                columns = [pa.array([name.as_py()] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(pages, pa.int64()), pa.array(urls, pa.string()), pa.array(moments, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["archive", "place", "page", "url", "moment", "size", "digest", "response"])

    return archives.select("archive", "content", "pages").mapInArrow(read, "archive string, place long, page long, url string, moment string, size long, digest string, response binary")


def to_warc(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive, content, pages: WARC files. Of equal payloads of at least so many bytes the one with the least page is a response, the others revisit it."""
    order = F.struct(F.col("page").isNull().alias("none"), "page", "archive", "place", "url", "moment")
    shared = captures.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    known = captures.join(shared.select("of", "first"), captures["digest"] == F.col("of"), "left")
    again = F.col("first").isNotNull() & (F.col("size") >= least_bytes) & ((F.col("archive") != F.col("first.archive")) | (F.col("place") != F.col("first.place")))
    columns = ["archive", "place", "page", "url", "moment", "digest", "response"]
    rows = known.select(*columns, F.when(again, F.col("first")).alias("first"), F.spark_partition_id().alias("task"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            for part in slices(batch, 6, ARCHIVE_BYTES):
                name = f"part-{part.column(8)[0].as_py():06d}-{k:06d}.warc.gz"
                info = b"software: meshwright\r\nformat: WARC File Format 1.1\r\n"
                about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", arc_to_warc_moment(CAPTURED)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                out = [warc_record(about, info)]
                for archive, place, _, url, moment, sha, response, first in zip(*[c.to_pylist() for c in part.columns[:8]]):
                    body = zlib.decompress(response)
                    fields = [("WARC-Record-ID", record_id(archive, place)), ("WARC-Date", arc_to_warc_moment(moment)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
                    if first:
                        head, _, payload = split_http(body)
                        body = head + b"\r\n\r\n"
                        fields += [
                            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                            ("WARC-Refers-To", record_id(first["archive"], first["place"])),
                            ("WARC-Refers-To-Target-URI", first["url"]),
                            ("WARC-Refers-To-Date", arc_to_warc_moment(first["moment"])),
                        ]
                        out.append(warc_record([("WARC-Type", "revisit"), *fields], body))
                    else:
                        out.append(warc_record([("WARC-Type", "response"), *fields], body))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary()), pa.array([part.column(2).to_pylist()], pa.list_(pa.int64()))], names=["archive", "content", "pages"])
                k += 1

    return rows.mapInArrow(store, "archive string, content binary, pages array<long>")


def parse_archives(archives: DataFrame) -> DataFrame:
    """kind, record, pages, digest, size: each response with its page, recomputed digest and length; of each archive, the pages that revisit a record, with
    the digest that they declare."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, pages in zip(*batch.columns):
                out: list[tuple] = []
                revisits: dict[tuple[str, str], list] = {}
                index = iter(pages.as_py())
                for fields, body in parse_warc(content.as_py()):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    _, http, payload = split_http(body)
                    sha, page = fields["WARC-Payload-Digest"].removeprefix("sha1:"), next(index)
                    if fields["WARC-Type"] == "revisit":
                        revisits.setdefault((fields["WARC-Refers-To"], sha), []).append(page)
                        continue
                    if digest(payload) != sha or len(payload) != int(http["Content-Length"]):
                        raise ValueError("a payload's digest does not hold")
                    out.append(("response", fields["WARC-Record-ID"], [page], sha, len(payload)))
                out += [("revisit", of, own, sha, None) for (of, sha), own in revisits.items()]
                kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64()]
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "record", "pages", "digest", "size"])

    return archives.select("content", "pages").mapInArrow(read, "kind string, record string, pages array<long>, digest string, size long")


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture. A revisit's length and page are those of the response that it refers
    to; it is an error if there is none, or if its payload has another digest."""
    records = write_table(parse_archives(archives), "warc-records", "zstd")
    responses = records.where("kind = 'response'").select("record", F.col("pages")[0].alias("page"), "digest", "size")
    own = responses.select(F.col("page").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    asked = records.where("kind = 'revisit'").select("record", "pages", F.col("digest").alias("declared"))
    faced = asked.join(responses, "record", "left")
    checked = F.when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a revisit's response is not there or differs: "), "record")).cast("string"))
    others = faced.select(F.explode("pages").alias("page_id"), F.col("size").alias("payload_bytes"), checked.alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("page").alias("refers_to"))
    return own.unionByName(others)


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the WARC files made of its ARC capture."""
    legacy = write_table(to_arc(read_table(spark, sf_dir, "pages")), "arc", "uncompressed")
    archives = write_table(to_warc(read_arc(legacy)), "warc", "uncompressed")
    return read_warc(archives)
