"""Legacy archive converter: ARC files (versions 1 and 2) to WARC/1.1 with revisit records, a writer and a reader.

An ARC file begins with a version block whose first line, ``filedesc://...``, declares its own length; the block's
second line names the version, its third the fields of the header lines that follow. Each record is a header line, as
many bytes as the line's last field declares, and a newline. The converter parses header lines by the declared version,
takes exactly the declared bytes, and synthesises what WARC needs and ARC lacks: a record id (a name-based UUID, so
reruns agree), an ISO date, a type, a block digest and a payload digest.

Archives are written by Spark's text writer with the record end (CR LF CR LF) as its separator, so that the commit
protocol, any Hadoop file system and retries of lost tasks work as for every other table. The reader takes whole files
and follows Content-Length, so payloads may contain any bytes.

Defined cases: a null payload is empty. A record that ends before its declared length, a header line with a wrong
number of fields and a length that is not a number give a row with ``problem`` set and no further records of that file.
An empty archive gives no row, and an empty table no archive. Only the first record of a file is its version block: later ones whose url
begins with ``filedesc://`` are records. A very long page ends its archive. Of equal payloads of at least MIN_REVISIT bytes, the one with the largest key is the response;
rows with that same key are all responses; where every key is null all are. Repeated rows are records of their own. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped

MIN_REVISIT = 1000
#: An ARC file ends with the page that reaches either.
PAGES_PER_ARC, ARC_BYTES = 200, 16 << 20
RECORDS_PER_FILE = 20_000
#: The field lists of both ARC versions, the revisit profile of WARC/1.1.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD_SCHEMA = "archive string, offset long, version int, record_id string, uri string, ip string, warc_date string, mime string, status string, head binary, payload binary, payload_bytes long, payload_digest string, payload_digest32 string, block_digest32 string, head_digest32 string, key long, problem string"


# --- ARC -----------------------------------------------------------------------------------------------------------


def _token(x: str | None, default: str) -> str:
    return re.sub(r"\s", "%20", x) if x else default


def arc_file(name: str, version: int, records: list[tuple[str, str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, mime, status, content) records."""
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 foliant\n{fields}\n\n".encode()
    more = {1: "", 2: f" 200 - - 0 {name}"}[version]
    out = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{more} {len(body)}\n".encode(), body]
    at = sum(map(len, out))
    for url, ip, date, mime, status, content in records:
        more = {1: "", 2: f" {status} {zlib.crc32(content):08x} - {at} {name}"}[version]
        out += [f"{_token(url, '-')} {_token(ip, '0.0.0.0')} {date} {_token(mime, 'no-type')}{more} {len(content)}\n".encode(), content, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """(archive, content) ARC files of both versions in turn; page_id travels as an HTTP header."""

    def run(batches):
        task, n, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"pages-{task}-{n}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_file(name, 1 + n % 2, rows)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast("binary")):
                html = html.as_py() or b""
                key = "" if page_id is None else f"X-Record-Key: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(html)}\r\n\r\n"
                rows.append((url or f"urn:page:{page_id}", "192.0.2.1", "20240101120000", "text/html", "200", head.encode() + html))
                held += len(html)
                if len(rows) == PAGES_PER_ARC or held >= ARC_BYTES:
                    yield archive()
                    n, rows, held = n + 1, [], 0
        if rows:
            yield archive()

    return shipped(pages).select("page_id", "url", "html").mapInArrow(run, "archive string, content binary")


def inflated(content: bytes) -> bytes:
    """The content, decompressed if it is a series of gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(content) + z.flush())
        content = z.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file as dicts of its own field names, with offset, version and content or problem."""
    content, at, version, fields, begun = inflated(content), 0, 0, [], False
    while at < len(content):
        if content[at : at + 1] in b"\r\n":  # what separates records
            at += 1
            continue
        stop = content.find(b"\n", at)
        line = content[at : stop if stop >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        got = line.split(" ")
        row = {"offset": at, "version": version}
        if stop < 0 or not got[-1].isdigit() or not got[-1].isascii():
            yield row | {"problem": "no declared length"}
            return
        begin, size = stop + 1, int(got[-1])
        if begin + size > len(content):
            yield row | {"problem": "truncated"}
            return
        if not begun and line.startswith("filedesc://"):  # later on, a url like any other
            lines = content[begin : begin + size].decode("utf-8", "replace").splitlines()
            first = lines[0].split(" ")[0] if lines else ""
            version = int(first) if first.isdigit() and int(first) in ARC_FIELDS else 0
            fields = lines[1].split(" ") if len(lines) > 1 and lines[1] else ARC_FIELDS.get(version, [])
        elif not version or len(got) != len(fields):
            yield row | {"problem": "header line does not fit the version"}
            return
        else:
            yield row | dict(zip(fields, got)) | {"content": content[begin : begin + size], "problem": None}
        at, begun = begin + size, True


def iso_date(arc: str) -> str:
    """14 digits (12 in old files) as an ISO date; what is missing counts as the earliest."""
    d = re.sub(r"\D", "", arc)
    d = (d + "00000101000000"[len(d) :] if len(d) < 14 else d)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def base32_sha1(*parts: bytes) -> str:
    h = hashlib.sha1()
    for x in parts:
        h.update(x)
    return base64.b32encode(h.digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload, of an HTTP response; any other block is all payload."""
    if block[:5] == b"HTTP/" and (m := re.search(rb"\r?\n\r?\n", block)):
        return block[: m.end()], block[m.end() :]
    return b"", block


def header(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb"[ \t]*:[ \t]*(.*?)\r?$", head)
    return m[1] if m else None


def arc_to_records(archives: DataFrame) -> DataFrame:
    """WARC fields, head and payload of every record of the ARC files in (archive, content)."""
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [_record(archive, x) for x in parse_arc(content.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=ARROW_RECORDS)

    return shipped(archives).select("archive", "content").mapInArrow(run, RECORD_SCHEMA)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
ARROW_RECORDS = pa.schema([(n, _KINDS[k]) for n, k in (x.split(" ") for x in RECORD_SCHEMA.split(", "))])


def record_key(head: bytes) -> int | None:
    """The key that a record's header names, if it is a number of signed 64 bits."""
    key = header(head, b"X-Record-Key")
    key = int(key) if key and re.fullmatch(rb"-?\d{1,19}", key) else None
    return key if key is not None and -(1 << 63) <= key < 1 << 63 else None


def _record(archive: str, x: dict) -> tuple:
    if x["problem"]:
        return (archive, x["offset"], x["version"], *[None] * 14, x["problem"])
    head, payload = split_http(x["content"])
    digest = hashlib.sha1(payload)
    key = record_key(head)
    date = iso_date(x["Archive-date"])
    name = f"{x['URL']} {date} {key} {digest.hexdigest()}"
    return (
        archive, x["offset"], x["version"], f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", x["URL"], x["IP-address"], date, x["Content-type"], x.get("Result-code"),
        head, payload, len(payload), digest.hexdigest(), base64.b32encode(digest.digest()).decode(), base32_sha1(head, payload), base32_sha1(head), key, None,
    )


# --- WARC ----------------------------------------------------------------------------------------------------------


def revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """For each payload digest that several records of at least ``least`` bytes share: the record with the largest key."""
    first = F.max(F.struct("key", "record_id", "uri", "warc_date"))
    groups = records.filter((F.col("payload_bytes") >= least) & F.col("key").isNotNull()).groupBy("payload_digest").agg(first.alias("f"), F.count("*").alias("n"))
    return groups.filter("n > 1").select("payload_digest", F.col("f.key").alias("to_key"), F.col("f.record_id").alias("to_id"), F.col("f.uri").alias("to_uri"), F.col("f.warc_date").alias("to_date"))


def warc_text(records: DataFrame, groups: DataFrame, strict: bool = False) -> DataFrame:
    """Column value: each record as WARC/1.1, without the record end; an equal payload's later copy as a revisit.

    Rows with a problem have nothing to write: they are left out, or end the job if ``strict``."""
    damage = F.raise_error(F.concat_ws(": ", F.lit("damaged archive"), "archive", "problem")).cast("boolean")
    whole = F.when(F.col("problem").isNull(), True).otherwise(damage) if strict else F.col("problem").isNull()
    joined = records.filter(whole).join(groups, "payload_digest", "left")
    revisit = F.col("to_key").isNotNull() & (~F.col("to_key").eqNullSafe(F.col("key")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    common = [
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("uri")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest32")), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest32")).otherwise(F.col("block_digest32")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), "to_id", F.lit(">"))), line("WARC-Refers-To-Target-URI", F.col("to_uri")), line("WARC-Refers-To-Date", F.col("to_date")))).otherwise(""),
        line("Content-Type", F.when(F.length("head") > 0, "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", (F.length("head") + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")), F.lit("\r\n"),
    ]
    block = F.concat(F.concat(*common).cast("binary"), F.col("head"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    return joined.select(block.cast("string").alias("value"))


def write_warc(records: DataFrame, groups: DataFrame, path: str, strict: bool = False) -> None:
    (warc_text(records, groups, strict).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    content, at = inflated(content), 0
    while (stop := content.find(b"\r\n\r\n", at)) >= 0:
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = stop + 4 + int(fields["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its Content-Length says")
        yield fields, content[stop + 4 : end]
        at = end + 4


WARC_SCHEMA = "record_id string, record_type string, uri string, warc_date string, refers_to_id string, key long, payload_bytes long, payload_digest string, valid boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per WARC record; digests are recomputed from the blocks read, and ``valid`` says that they are as declared."""
    arrow = pa.schema([(n, _KINDS.get(k, pa.bool_())) for n, k in (x.split(" ") for x in WARC_SCHEMA.split(", "))])
    names = arrow.names

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    head, payload = split_http(block)
                    kind, declared = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(header(head, b"Content-Length") or 0) if kind == "revisit" else len(payload)
                    digest = base64.b32decode(declared).hex() if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                    valid = base64.b32decode(declared).hex() == digest and fields["warc-block-digest"] == "sha1:" + base32_sha1(block)
                    rows.append((fields["warc-record-id"].strip("<>"), kind, fields["warc-target-uri"], fields["warc-date"], fields.get("warc-refers-to", "").strip("<>") or None, record_key(head), size, digest, valid))
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return shipped(files).mapInArrow(run, WARC_SCHEMA)


def with_responses(read: DataFrame) -> DataFrame:
    """The records read, with the key of the response that a revisit's WARC-Refers-To names. Responses are joined by their own id, so
    that they do not meet in one task for want of another."""
    key = read.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("key").alias("_key")).dropDuplicates(["_id"])
    joined = read.join(key, F.coalesce("refers_to_id", "record_id") == F.col("_id"), "left")
    return joined.withColumn("refers_to", F.when(F.col("refers_to_id").isNotNull(), F.col("_key"))).drop("_id", "_key")
