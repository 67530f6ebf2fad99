"""Content-addressed web archive.

``archive`` writes two tables into an archive folder:

* ``payloads`` - each distinct payload once, under its SHA-256 digest;
* ``headers`` - each record's exact header block (bytes), its digest and its place.

``read_archive`` reads both back, checks that every stored payload still has its digest, and joins records to
payloads; ``record_bytes`` rebuilds the original WARC records byte for byte; ``parsed_records`` reads rebuilt records again, from their bytes.
``read_warc`` parses existing WARC files (plain or gzip) into records that ``archive_records`` stores in the same way.

Payloads are digested before anything moves. One aggregation by digest keeps one copy and the largest id of each group;
it combines copies on the map side, so a payload with millions of copies crosses the network once a task.
Equal SHA-256 digests with unequal lengths or SHA-1 digests stop the job.

Record ids are ``urn:page:<page_id>:<number of the row>``, so that repeated and null page_ids have records of their own; the number is that of
the row in the scan, which is the same when a task runs again. Pages carry no time of capture, so WARC-Date is a parameter.

Defined results: null html is an empty payload; null page_id or url become the header value ``-``; repeated rows
are records of their own, and where the largest page_id of a payload occurs on several rows, each of these is a response;
an empty table gives an empty archive; other columns are ignored, also those named like columns made here. Very long payloads are
moved whole, one a row.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, utf8, work_dir

#: Payloads shorter than this are never replaced by a revisit record.
MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"
#: WARC-Date of records whose time of capture is unknown.
DATE = "1970-01-01T00:00:00Z"


def _urn(page_id: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), number.cast("string"), F.lit(">"))


def header_block(r: dict[str, Column], date: str = DATE) -> Column:
    """The record's header lines with the empty line that ends them."""
    revisit = r["refers_to"].isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return utf8(
        F.concat(
            F.lit("WARC/1.1" + CRLF),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", _urn(r["page_id"], r["number"])),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.coalesce(F.regexp_replace(r["url"], "[\r\n]", " "), F.lit("-"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), r["sha1"])),
            F.when(revisit, F.concat(line("WARC-Refers-To", _urn(r["refers_to"], r["refers_number"])), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
            line("WARC-Payload-Length", r["length"].cast("string")),
            line("Content-Length", F.when(revisit, F.lit("0")).otherwise(r["length"].cast("string"))),
            F.lit(CRLF),
        )
    )


def digested(records: DataFrame) -> DataFrame:
    """``records`` with the digests and length of their payload."""
    return records.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})


def store_payloads(records: DataFrame, path: str, *more: Column) -> None:
    """Write each distinct payload of digested records once."""
    same = (F.min("sha1") == F.max("sha1")) & (F.min("length") == F.max("length"))
    stored = records.groupBy("digest").agg(*more, F.first("payload").alias("payload"), F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("unequal payloads with one SHA-256 digest"))).alias("verified"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as a content-addressed archive at ``path``."""
    body = utf8(F.coalesce(pages["html"].cast("string"), F.lit("")))
    records = digested(pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"), F.monotonically_increasing_id().alias("number"), body.alias("payload")))
    store_payloads(records, path, F.max(F.struct("page_id", "number")).alias("winner"))
    winners = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "winner")
    placed = records.drop("payload").join(winners, "digest", "left")
    largest = F.col("winner.page_id")
    revisit = (F.col("length") >= MIN_REVISIT_BYTES) & (F.col("page_id").isNull() & largest.isNotNull() | (F.col("page_id") < largest))
    placed = placed.withColumns({"refers_to": F.when(revisit, largest), "refers_number": F.when(revisit, F.col("winner.number"))})
    cols = {c: placed[c] for c in placed.columns}
    placed.select("page_id", "digest", header_block(cols, date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def header_field(header: Column, name: str) -> Column:
    """A header's value, null where the field is absent."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)\r", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records joined to their payloads: page_id, digest, header, payload_bytes, sha1 and, if wanted, payload.

    Length and SHA-1 are of the bytes as read back; a payload that no longer has its digest stops the job.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = payloads.select(
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, F.sha1("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest"))).alias("sha1"),
        *(["payload"] if with_payload else []),
    )
    return spark.read.parquet(f"{path}/headers").join(checked, "digest")


def record_bytes(records: DataFrame) -> Column:
    """The WARC record, byte for byte: header block, the payload unless it is a revisit, two line ends."""
    end = F.lit((CRLF * 2).encode())
    return F.when(header_field(records["header"], "WARC-Type") == "revisit", F.concat(records["header"], end)).otherwise(F.concat(records["header"], records["payload"], end))


def parsed_records(records: DataFrame) -> DataFrame:
    """page_id, header, payload, of rebuilt records read from their bytes: the header ends at the first empty line, Content-Length tells the block.

    A revisit's payload is that of the record it refers to, which the join by digest gives. Records that don't parse stop the job.
    """
    end = F.octet_length(F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)) + 4
    r = records.select("page_id", "payload", record_bytes(records).alias("record")).select("page_id", "payload", "record", F.substring("record", F.lit(1), end).alias("header"))
    length = header_field(F.col("header"), "Content-Length").cast("int")
    block = F.substring("record", F.octet_length("header") + 1, length)
    sound = (F.octet_length("header") + length + 4 == F.octet_length("record")) & (F.substring("record", F.octet_length("record") - 3, F.lit(4)) == F.lit((CRLF * 2).encode()))
    said = F.when(header_field(F.col("header"), "WARC-Type") == "revisit", F.col("payload")).otherwise(block)
    return r.select("page_id", "header", F.when(sound, said).otherwise(F.raise_error(F.lit("a rebuilt record does not parse")).cast("binary")).alias("payload"))


def parse_warc(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Place, header block and payload of each record of a WARC file; gzip members are opened first."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        header = data[at : cut + 4]
        length = re.search(rb"(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r", header)
        if length is None or cut + 4 + int(length[1]) > len(data):
            raise ValueError(f"the WARC record at byte {at} has no proper length")
        end = cut + 4 + int(length[1])
        yield at, header, data[cut + 4 : end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} has no end")
        at = end + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            for place, header, payload in parse_warc(content.as_py()):
                yield pa.record_batch([pa.array([name.as_py()]), pa.array([place], pa.int64()), pa.array([header], pa.binary()), pa.array([payload], pa.binary())], names=["file", "place", "header", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, place, header and payload of the records of WARC files. A file is read whole, as the reader of binary files does."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parsed, "file string, place long, header binary, payload binary")


def archive_records(records: DataFrame, path: str) -> None:
    """Write records (file, place, header, payload) as a content-addressed archive: payloads once, headers as they are."""
    own = digested(records)
    store_payloads(own, path)
    own.select("file", "place", "digest", "header").write.option("compression", "zstd").parquet(f"{path}/headers")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """file, place and record: the bytes of each record of an archive of WARC files."""
    r = read_archive(spark, path)
    return r.select("file", "place", F.concat(r["header"], r["payload"], F.lit((CRLF * 2).encode())).alias("record"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "archive")
    archive(table(spark, sf_dir, "pages"), path)
    r = parsed_records(read_archive(spark, path)).select("page_id", "header", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    same = F.concat(F.lit("sha1:"), r["sha1"]) == header_field(r["header"], "WARC-Payload-Digest")
    refers = F.regexp_extract(header_field(r["header"], "WARC-Refers-To"), r"^<urn:page:(-?\d+):\d+>$", 1)
    return r.select(
        "page_id",
        "payload_bytes",
        F.when(same, r["sha1"]).otherwise(F.raise_error(F.lit("header and payload disagree"))).alias("payload_digest"),
        header_field(r["header"], "WARC-Type").alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )
