"""Content-addressed web archive: WARC files that hold each payload once, and reading them back.

A payload's name is its SHA-256, which decides what is equal; SHA-1 in base32 is the field that the format has. Writing:
headers are a table without payloads, payloads one with a row for each name; of the records with equal payloads one is a
response, whose payload follows its header, the others are revisits that refer to it. Spark's text writer makes the
files: a row is one record's bytes, the line separator the two line ends that close a record. Reading: whole files are
parsed by their records' lengths, exact headers and payloads become a table again, every payload's bytes are held against
both digests, and the join of headers and payloads by name reconstructs every record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.store import Work, few, release, tune

#: Bytes of an archive file before compression, on average; a reader holds one file at a time.
FILE_BYTES = 8 << 20
#: Fixed values of the format.
VERSION, CLOSE = "WARC/1.1", "\r\n\r\n"
#: The header's own field for a payload's name.
NAME = "X-Payload-SHA256"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column of hexadecimal digits in base32."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b[column].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([out if c == column else b[c] for c in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, kinds)


def named(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, size, name, digest (hexadecimal): all in the JVM, so payloads don't go through Python."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    return rows.withColumns({"size": F.octet_length("payload").cast("long"), "name": F.sha2("payload", 256), "digest": F.sha1("payload")})


def headers(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, size, name, digest (base32), record_type, refers_to: a row for each row of named().

    least: payloads of fewer bytes are all responses. Of equal payloads the one with the largest page_id is the response;
    a null page_id is the smallest, and of rows that share the page_id one with the largest url (null the smallest) is
    it. So a payload of `least` bytes or more is stored once, also if rows are repeated.
    """
    each = pages.groupBy("page_id", "url", "size", "name", "digest").agg(F.count("*").alias("n"))
    first = each.groupBy(F.col("name").alias("of")).agg(F.max(F.struct("page_id", "url")).alias("first"))
    each = base32(each, "digest").join(first, F.col("name") == F.col("of"))
    rows = each.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    response = F.expr(f"size < {least} or (k = 1 and page_id <=> first.page_id and url <=> first.url)")
    return rows.select("page_id", "url", "size", "name", "digest", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("first.page_id")).alias("refers_to"))


def encoded(heads: DataFrame) -> DataFrame:
    """value: each record's header with the blank line that ends it, beside its other columns."""
    uri = F.coalesce(F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x20]", "%20"), "^$", "urn:none"), F.lit("urn:none"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), page("page_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit(f"{NAME}: "), "name"), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), page("refers_to"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
    ]
    return heads.withColumn("value", F.concat(F.concat_ws("\r\n", *lines), F.lit(CLOSE)))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Gzipped archive files. Only one row of each payload is shuffled; a task rolls its files at FILE_BYTES on average."""
    rows = named(pages)
    heads = encoded(headers(rows.drop("payload"), least))
    payloads = rows.groupBy("name").agg(F.first("payload").alias("payload"))
    responses = heads.where("record_type = 'response'").select("name", "value").join(payloads, "name")
    whole = responses.select(F.concat("value", F.col("payload").cast("string")).alias("value")).unionByName(heads.where("record_type = 'revisit'").select("value"))
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 500), F.count("*")).first()
    each = max(1, FILE_BYTES * total[1] // max(total[0] or 1, 1))
    whole.write.option("lineSep", CLOSE).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", each).text(path)


_field = re.compile(rb"^([^:\r\n]+): ?([^\r\n]*)\r$", re.M)


def unzipped(raw: bytes | memoryview) -> bytes:
    """All members of a gzip file, or the bytes themselves."""
    raw, out = bytes(raw), []
    if raw[:2] != b"\x1f\x8b":
        return raw
    while raw:
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw) + z.flush())
        raw = z.unused_data
    return b"".join(out)


def parse(raw: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields, exact header bytes and block of each record."""
    at, raw = 0, unzipped(raw)
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        fields = {k.decode().lower(): v.decode() for k, v in _field.findall(raw, at, end - 2)}
        size = int(fields["content-length"])
        yield fields, raw[at:end], raw[end : end + size]
        at = end + size + len(CLOSE)


def _page(x: str | None) -> int | None:
    x = (x or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if re.fullmatch(r"-?\d+", x) else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files: page_id, record_type, refers_to, name, digest, header (exact bytes), payload (its block).

    A response whose payload doesn't have both of its digests raises an error.
    """
    kind = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("name", pa.string()), ("digest", pa.string()), ("header", pa.binary()), ("payload", pa.binary())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["content"]:
                rows, size = [], 0
                for f, header, block in parse(raw.as_buffer()):
                    d, n, response = f["warc-payload-digest"].removeprefix("sha1:"), f[NAME.lower()], f["warc-type"] == "response"
                    if response and (digest(block) != d or hashlib.sha256(block).hexdigest() != n):
                        raise ValueError(f"payload of {f['warc-record-id']} doesn't have its digests")
                    rows.append((_page(f["warc-record-id"]), f["warc-type"], _page(f.get("warc-refers-to")), n, d, header, block if response else None))
                    size += len(block) + len(header)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(explode, "page_id long, record_type string, refers_to long, name string, digest string, header binary, payload binary")


def reconstruct(store: DataFrame) -> DataFrame:
    """Every record with its full payload: exact headers joined to the payloads, of which there is one for each name."""
    payloads = store.where("record_type = 'response'").groupBy("name").agg(F.first("payload").alias("payload"))
    return store.drop("payload").join(payloads.hint("merge"), "name")  # a sorted join, whose frequent names Spark splits


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an archive of all pages to the shared folder, reads it back and reports every record as reconstructed."""
    tune(spark)
    work = Work(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{work.at}/archive")
    release(spark)
    full = reconstruct(read(spark, f"{work.at}/archive"))  # headers and payloads are each parsed from the files: no table beside them
    # what is reported of a payload is taken from the bytes that the join gave back
    rows = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    return few(base32(rows, "payload_digest"))


_bits = "array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * CAST('0x' || c AS INTEGER) + 1, 4) FOR c IN string_split(sha1(x), '')], '')"
OP2_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), d AS (SELECT page_id, strlen(x) AS payload_bytes, {_bits} AS bits, max(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
