"""WARC archives with resolved revisits.

Captures (id, url, date, payload) get a SHA-1 digest and a length each. Headers, without their payloads, meet by digest
and length: of equal payloads of at least LEAST bytes the capture with the largest id is the response, and the others
become revisit records that refer to it. Archives are WARC/1.1 files with fresh headers, gzipped, written by Spark's own
writer so that a lost executor leaves no torn file, and at most FILE_RECORDS records and about FILE_BYTES bytes long (a larger
record has a file of its own); the writer's line separator
is the two line ends that close a record. Reading parses each file by its Content-Length fields, takes digests of the
payloads that are there, and joins revisits to their responses for what only those hold.

Defined cases: null payload is empty; a null url or date is written as an empty field; each row gives one record, so equal
rows give equal records; of captures with one payload, all that have the largest id are responses (there are several if
that id is repeated), and the others refer to that id once; captures without an id are never referred to; payloads may be of any
size that a row may have, and are read file by file; an empty table gives archives without records and no rows. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh_path, table

LEAST, FILE_RECORDS, FILE_BYTES = 1000, 512, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "id long, record_type string, record_id string, refers_to string, url string, date string, payload_bytes long, payload_digest string"


def captures(rows: DataFrame) -> DataFrame:
    """(id, url, date, payload, payload_bytes, payload_digest) of rows with id, url, date and a string or binary payload."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ").alias(c) for c in ("url", "date")]
    return rows.select(F.col("id").cast("long").alias("id"), *clean, payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})


def originals(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """(payload_digest, payload_bytes, original) of payloads that occur more than once; original is the response's id."""
    large = headers.where(F.col("payload_bytes") >= least)
    return large.groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")


def with_types(found: DataFrame, least: int = LEAST) -> DataFrame:
    """captures with record_type, and refers_to for revisits."""
    same = cut(originals(found.select("id", "payload_bytes", "payload_digest"), least), "warc-originals")
    other = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    return found.join(same, ["payload_digest", "payload_bytes"], "left").select("id", "url", "date", "payload", "payload_bytes", "payload_digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("original")).alias("refers_to"))


def record_id(number: F.Column) -> F.Column:
    """A record's name: a UUID made from its capture's id."""
    h = F.md5(F.concat(F.lit("capture:"), F.coalesce(number.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def records(typed: DataFrame) -> DataFrame:
    """A WARC record each, without its closing line ends, as one binary-safe string column."""

    def field(name: str, value: F.Column) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", record_id(F.col("id"))),
        F.when(F.col("id").isNull(), "").otherwise(field("X-Capture-ID", F.coalesce(F.col("id").cast("string"), F.lit("")))),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Date", F.col("date")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(field("WARC-Refers-To", record_id(F.col("refers_to"))), field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        field("Content-Type", F.when(revisit, F.lit("message/http")).otherwise(F.lit("text/html"))),
        field("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return typed.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))


def write_archives(typed: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Files of at most file_records records and about FILE_BYTES bytes; records of different sizes go to different files."""
    largest, low = typed.agg(F.max("payload_bytes")).first()[0] or 0, 0
    for number, n in enumerate((FILE_RECORDS, FILE_RECORDS // 16, 1)):
        high = FILE_BYTES // n if n > 1 else None
        part = typed if largest < (high or 0) and not number else typed.where((F.col("payload_bytes") >= low) & (F.lit(True) if high is None else F.col("payload_bytes") < high))
        records(part).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", min(n, file_records)).text(path)
        if high is None or largest < high:
            break
        low = high


def _parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record of an archive."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        at = begin + int(head["Content-Length"])
        yield head, raw[begin:at]
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} isn't closed")
        at += 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record: its header fields, and the length and digest of the payload that it holds[, the payload]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out = []
                for head, block in _parse(zlib.decompress(content.as_py(), 31)):
                    number = head.get("X-Capture-ID")
                    whole = head["WARC-Type"] != "revisit"
                    out.append((None if number is None else int(number), head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Target-URI"], head["WARC-Date"], len(block) if whole else None, hashlib.sha1(block).hexdigest() if whole else head["WARC-Payload-Digest"].removeprefix("sha1:"), block if with_payload else None))
                for k in range(0, len(out), 500):
                    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
                    columns = [pa.array(x, t) for x, t in zip(zip(*out[k : k + 500]), kinds)]
                    names = [x.split()[0] for x in _RECORD.split(", ")]
                    yield pa.RecordBatch.from_arrays(columns if with_payload else columns[:-1], [*names, "payload"] if with_payload else names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORD + ", payload binary" * with_payload)


def resolve(found: DataFrame) -> DataFrame:
    """Records read from archives, each revisit with its response's id in refers_to_id and its response's payload length."""
    responses = found.where("record_type = 'response'")
    wanted = found.where("record_type = 'revisit'")
    named = responses.select(F.col("record_id").alias("refers_to"), F.col("id").alias("refers_to_id"), F.col("payload_bytes").alias("full"), F.col("payload_digest").alias("full_digest"))
    named = named.join(wanted.select("refers_to").distinct(), "refers_to", "left_semi").dropDuplicates(["refers_to"])  # captures of one id share a record's name
    back = wanted.join(named, "refers_to", "left").select("id", "record_type", "record_id", "url", "date", F.col("full").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "refers_to_id")
    return responses.select("id", "record_type", "record_id", "url", "date", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to_id")).unionByName(back)


def deduplicate(rows: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Writes captures as archives under path and reads their records back, revisits resolved."""
    write_archives(with_types(captures(rows), least), path)
    return resolve(cut(read_archives(rows.sparkSession, path), "warc-records"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("html").alias("payload"))
    found = deduplicate(pages, fresh_path(spark, "warc"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").alias("refers_to"), "url")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
m AS (SELECT h, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
    CASE WHEN original IS NOT NULL AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN original <> page_id THEN original END AS refers_to, url
FROM p LEFT JOIN m ON p.h = m.h
"""
