"""Operator 3, a content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest in ``payloads``; each record's exact header block is
kept apart in ``headers``, with the digest as the link. Records are put together again by a join on the
digest. Of the records with equal payloads of at least ``least`` bytes the first is a response and the
others revisit it; smaller payloads are stored once all the same, but their records are all responses.
"""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 100
#: The capture time written into each header: a parameter, so that reruns give the same bytes.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def captures(pages: DataFrame, id_col="page_id", url_col="url", body_col="html") -> DataFrame:
    """``page_id, url, payload, digest, payload_bytes``; a null body is empty, a null url stays null."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    return out.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def _header(kind: str) -> F.Column:
    uid = lambda page, row: F.md5(F.concat_ws("|", F.coalesce(F.col(page).cast("string"), F.lit("null")), "digest", F.col(row).cast("string")).cast("binary"))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(c, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    # A line break in a url would end the header line; it is percent-encoded.
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    parts = [
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.lit(kind)),
        line("WARC-Record-ID", urn(uid("page_id", "row"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
    ]
    if kind == "revisit":
        parts += [
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(uid("owner.page_id", "owner.row"))),
            line("X-Refers-To-Page-ID", F.coalesce(F.col("owner.page_id").cast("string"), F.lit(""))),
            line("Content-Length", F.lit("0")),
        ]
    else:
        parts += [line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string"))]
    return F.concat(*parts, F.lit(CRLF))


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, **columns) -> None:
    """Writes ``folder/headers`` and ``folder/payloads`` (Parquet). A null or empty body is an empty payload; very long ones
    are stored whole; other columns play no part, whatever their names; an empty table gives an empty archive.

    Every input row gives one record, repeated rows and null ids included: among equal payloads the
    smallest page id leads, nulls last, and one row of several with that id. Only digests, ids and
    lengths are grouped; payload bytes are aggregated within tasks before they are shuffled, so that a
    payload which a third of the rows share moves once per task.
    """
    got = captures(pages, **columns)
    # Row numbers tell repeated rows apart; they are fixed by being written.
    facts = common.written(got.select("page_id", "url", "digest", "payload_bytes").withColumn("row", F.monotonically_increasing_id()), "captures")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("owner")
    owners = facts.where(F.col("payload_bytes") >= least).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = facts.join(owners, "digest", "left")
    revisit = F.col("owner").isNotNull() & (F.col("owner.row") != F.col("row"))
    headers = joined.select(
        "page_id", "url", "digest", "payload_bytes", "row",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("owner.page_id")).alias("refers_to"),
        F.when(revisit, _header("revisit")).otherwise(_header("response")).cast("binary").alias("header"),
    )
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")
    payloads = got.groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def _checked(payloads: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit("archive: payload does not match digest "), F.col("digest")))
    return payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")))


def records(spark, folder: str) -> DataFrame:
    """The original records: header fields, the verified ``payload`` and ``record``, a WARC record's exact bytes."""
    headers = spark.read.parquet(f"{folder}/headers")
    out = headers.join(_checked(spark.read.parquet(f"{folder}/payloads")), "digest", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return out.withColumn("record", F.concat("header", body, F.lit((CRLF * 2).encode())))


def read_back(spark, folder: str) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``, from the archive's bytes.

    Lengths and digests are taken anew from the stored payload bytes, the rest from the header blocks. A payload that
    is not of its digest, or a header whose Content-Length is not that of the record's block, is an error.
    The join carries these facts, not the bytes, so that a payload is not copied for each revisit.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    facts = _checked(stored).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, f"\n{name}: ([^\r]*)\r\n", 1)
    headers = spark.read.parquet(f"{folder}/headers").select(
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        F.nullif(field("X-Page-ID"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.nullif(field("X-Refers-To-Page-ID"), F.lit("")).cast("long").alias("refers_to"),
        field("Content-Length").cast("long").alias("block_bytes"),
        "url",
    )
    block = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    wrong = F.raise_error(F.concat(F.lit("archive: Content-Length does not fit the payload of "), F.col("digest"))).cast("long")
    checked = F.when(F.col("block_bytes") == block, F.col("payload_bytes")).otherwise(wrong)
    return headers.join(facts, "digest").select("page_id", checked.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")


def export_files(spark, folder: str, out: str, files: int | None = None) -> DataFrame:
    """Writes the records as ``.warc.gz`` files, one gzip member per record; returns file names and counts."""
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(batches):
        import uuid

        from pyspark import TaskContext

        name, f, n = f"{out}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            if f is None:
                fs, at = common.open_fs(name)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                f = fs.open_output_stream(at, compression=None)
            for x in b.column(0):
                f.write(gzip.compress(x.as_py(), 6, mtime=0))
                n += 1
        if f is not None:
            f.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "records": n}], schema=schema)

    got = records(spark, folder).select("record")
    return common.written((got.repartition(files) if files else got).mapInArrow(run, "file string, records long"), "warc_files")


def parse_records(data: bytes) -> list[tuple[dict, bytes]]:
    """(headers, block) of each record of a WARC file's bytes, gzipped by record or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if head["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(block).hexdigest() != head["WARC-Payload-Digest"]:
            raise ValueError("payload does not match its digest")
        out.append((head, block))
        at = end + 4 + n + 4
    return out


def read_files(spark, path: str) -> DataFrame:
    """``file, record_type, url, digest, header fields, payload`` of real WARC files, by binaryFile."""
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                for head, block in parse_records(data.as_py()):
                    yield pa.RecordBatch.from_pylist([{"file": name, "fields": list(head.items()), "payload": block}], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, fields map<string,string>, payload binary")


def op3_warc_store(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``pages``."""
    folder = common.new_path(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_back(spark, folder)


OP3_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id) AS rn, min(page_id) OVER (PARTITION BY d) AS lead_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND rn > 1 THEN lead_id END AS refers_to, url
FROM f
"""
