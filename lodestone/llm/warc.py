"""WARC archives: writing captures, and assembling them again from their records.

`write_archive` writes for each row a transaction of three records: a request, a response (or, where the row's payload is
that of another row, a revisit without it) and a metadata record; the latter two carry WARC-Concurrent-To. Rows of one
payload are told apart by id: the largest is the response. Spark's own text writer writes the files (its line separator
ends a record), so a lost task leaves nothing half-written. Files are gzip-compressed and hold about `FILE_BYTES`. Which
row answers for a payload is settled on ids and digests alone; bodies move once, by id and digest, so that a payload
shared by very many rows does not gather them.

`read_records` reads the records by their Content-Length, one at a time from the unpacking stream; `assemble` joins requests, responses and metadata through their
concurrent-to identifiers into one nested row per capture. Payload digests are computed anew from what was read.

Defined cases: a null payload is an empty one; a null address is written without target address; white space in an
address is percent-encoded; rows equal in id and payload share record ids and are paired by their order in the archive;
all rows of the largest id of a payload are responses; a row of null id is the response only where no other id is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint_dir, settle, spread

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES, FILE_ROWS, SALTS, BATCH_BYTES = 64 << 20, 2000, 16, 32 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(value: Column) -> Column:
    """The digest in upper-case base32: four letters for each five hex digits."""
    digits = F.sha1(value)
    part = lambda q: F.conv(F.substr(digits, q * 5 + 1, F.lit(5)), 16, 10).cast("int")
    four = lambda n: F.concat(*(F.substr(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)))
    return F.array_join(F.transform(F.transform(F.sequence(F.lit(0), F.lit(7)), part), four), "")


def _record_id(kind: str, *cols: Column) -> Column:
    h = F.sha1(F.concat_ws("|", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(headers: list[Column | None], block: Column) -> Column:
    """One record without its closing blank lines. Null headers are left out."""
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block))
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *headers, size), F.lit(END * 2), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("body"))
    own = own.withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    slim = settle(own.groupBy("id", "digest").agg(F.count("*").alias("n"), F.max(F.octet_length("body")).alias("size")))
    each = slim.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    rows_each = max(1, min(FILE_ROWS, FILE_BYTES * (each[0] or 1) // max(1, each[1] or 0)))
    shared = slim.groupBy("digest").agg(F.max("id").alias("response_id"), F.count("*").alias("ids")).filter("ids > 1")
    shared = shared.select(F.col("digest").alias("d"), "response_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = slim.select("id", "digest", spread(SALTS, F.col("id")).alias("salt"))
    told = salted.join(shared, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.when(F.col("d").isNull(), F.col("id")).otherwise(F.col("response_id")).alias("response_id"))
    own = own.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    fresh = F.col("id").eqNullSafe(F.col("response_id"))
    capture = _record_id("response", F.col("id"), F.col("digest"))
    target = named("WARC-Target-URI", F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20"))
    date, concurrent = F.lit(f"WARC-Date: {DATE}"), named("WARC-Concurrent-To", capture)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("body"), F.lit(END * 2))
    path_of = F.coalesce(F.regexp_extract(F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20"), "^[a-z]+://[^/]*(/.*)$", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(path_of != "", path_of).otherwise("/"), F.lit(f" HTTP/1.1{END}{END}"))
    fields = F.concat_ws(END, named("page", F.col("id")), F.when(~fresh, named("refers-to-page", F.col("response_id"))), F.lit(""))
    answer = [
        F.when(fresh, F.lit("WARC-Type: response")).otherwise("WARC-Type: revisit"), named("WARC-Record-ID", capture), date, target,
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(~fresh, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~fresh, named("WARC-Refers-To", _record_id("response", F.col("response_id"), F.col("digest")))),
        F.lit("Content-Type: application/http;msgtype=response"),
    ]
    records = [
        _record([F.lit("WARC-Type: request"), named("WARC-Record-ID", _record_id("request", F.col("id"), F.col("digest"))), date, target, concurrent, F.lit("Content-Type: application/http;msgtype=request")], ask),
        _record(answer, F.concat(http, F.when(fresh, F.col("body")).otherwise(""))),
        _record([F.lit("WARC-Type: metadata"), named("WARC-Record-ID", _record_id("metadata", F.col("id"), F.col("digest"))), date, target, concurrent, F.lit("Content-Type: application/warc-fields")], fields),
    ]
    whole = own.select(F.concat_ws(END * 2, *records).alias("value"))
    whole.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", rows_each).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records (headers by lower-case name, block) of one archive, one in memory at a time."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 20) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := source.readline()) != b"\r\n":
            if not line:
                raise ValueError("the headers of a record are cut off")
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = source.read(size := int(headers["content-length"]))
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield headers, block
        source.read(len(END) * 2)


RECORD = "file string, place long, type string, record_id string, concurrent_to string, target_uri string, date string, refers_to string, header_digest string, http_head string, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"


def framed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    out["payload_bytes"] = out["payload_bytes"].astype("Int64")
    return out


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives under `path`. A revisit's size and digest are those that it states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for place, (h, block) in enumerate(parse(raw)):
                    kind = h["warc-type"]
                    head = payload = size = fields = None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "metadata":
                        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in block.decode().split(END) if x)}
                    else:
                        head, _, body = block.partition(b"\r\n\r\n")
                        head = head.decode()
                    if kind == "response":
                        payload, size, digest = body, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    elif kind == "revisit":
                        size = next(int(x.partition(":")[2]) for x in head.split(END) if x.lower().startswith("content-length:"))
                    rows.append((file, place, kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), h["warc-date"], h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, head, size, digest, payload if with_payload else None, fields))
                    held += len(block) if with_payload else 256
                    if held > BATCH_BYTES:
                        yield framed(rows)
                        rows, held = [], 0
                yield framed(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: record_id, type, target_uri, refers_to, payload_*, and the structs request, response, metadata."""
    numbered = records.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    numbered = numbered.withColumn("turn", F.row_number().over(W.partitionBy("capture", "type").orderBy("file", "place")))
    answer = numbered.filter(F.col("type").isin("response", "revisit")).select("capture", "turn", "record_id", "type", "target_uri", "refers_to", "payload_bytes", "payload_digest", F.struct("date", "http_head", "header_digest", "payload").alias("response"))
    part = lambda kind, *cols: numbered.filter(F.col("type") == kind).select("capture", "turn", F.struct("record_id", "date", *cols).alias(kind))
    return answer.join(part("request", "http_head"), ["capture", "turn"], "left").join(part("metadata", "fields"), ["capture", "turn"], "left").drop("capture", "turn")


def archive_place(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes the archives of `pages`, reads them back and assembles the captures (without payloads)."""
    path = archive_place(pages.sparkSession)
    write_archive(pages, path, id_col)
    return assemble(settle(read_records(pages.sparkSession, path, with_payload=False)))
