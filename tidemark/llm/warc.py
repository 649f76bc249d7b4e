"""WARC archives: writing captures and assembling transactions (operator 4)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, batch, marked, marks, shared_dir, staged
from .exact_dedup import _ddl

CRLF = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, with built-in functions only: five hex digits are four base-32 ones."""
    h = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*four), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *parts: Column) -> Column:
    """A name-based record id (UUID version 8) of what identifies the capture."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _record(kind: str, rid: Column, uri: Column, date: str, content_type: str, block: Column, *more: tuple[str, Column | None]) -> Column:
    head: list[Column] = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), rid, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri]
    for name, value in more:
        head.append(F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit("")))
    return F.concat(*head, F.lit(f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", captures_per_file: int = 500) -> None:
    """Write a request, a response or revisit, and a metadata record for each row, as gzipped WARC 1.1.

    Of rows with equal payloads of ``min_bytes`` or more, those with the smallest id are responses and
    the others revisit them; smaller payloads are always responses. A null payload is empty, a null url
    too; rows with a null id revisit where another row has an id. Each row is a capture of its own, also
    where rows repeat in full. Payloads are equal when SHA-256, SHA-1 and length are.

    A revisit names the url and date of the first capture, and its record where only one row has the
    smallest id. Payloads stay where they are read. Repeated ones are found on narrow rows; a bitmap of fixed size tells
    which rows surely do not repeat, and these are written from the scan. Of the others a revisit needs no
    payload, so that only the first captures of repeated payloads pass a shuffle: a hot payload sends one
    row, or as many as there are rows with its smallest id.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).alias("id"), text(url_col).alias("url"), text(payload_col).alias("payload"))
    body = F.col("payload").cast("binary")
    # ``same`` tells payloads apart; ``nonce`` tells rows apart
    own = own.withColumn("same", F.sha2(body, 256)).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("nonce", F.monotonically_increasing_id())
    narrow = staged(own.select("id", "url", "same", "bytes", "nonce", sha1_base32(body).alias("digest")), "warc-rows")
    counted = narrow.filter(F.col("bytes") >= min_bytes).groupBy("same", "id", "url").agg(F.count("*").alias("n"))
    first = counted.groupBy("same").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url", "n"))).alias("first"), F.sum("n").alias("n"))
    first = staged(first.filter("n > 1 and first is not null").select("same", "first"), "warc-repeated")
    repeated = marks(first, "same")
    apart = marked(narrow, repeated, "same").filter("marked").drop("marked").join(first, "same", "left")
    is_first = F.col("first").isNull() | F.col("first.id").eqNullSafe(F.col("id"))
    # the first captures of repeated payloads, and payloads that only share a bit with one
    firsts = apart.filter(is_first).select("same", "id", F.col("first.url").alias("first_url"), F.coalesce("first.n", F.lit(2)).alias("first_n")).distinct()
    firsts = staged(firsts, "warc-first")
    flagged = marked(own, repeated, "same")
    in_place = flagged.filter(~F.col("marked")).drop("marked")
    moved = marked(flagged.filter("marked").drop("marked"), marks(firsts, "same", "id"), "same", "id").filter("marked").drop("marked")
    f = firsts.toDF("f_same", "f_id", "first_url", "first_n")
    moved = moved.join(f, (moved["same"] == f["f_same"]) & moved["id"].eqNullSafe(f["f_id"]))
    named = (F.col("first_n") == 1) & F.col("first_url").eqNullSafe(F.col("url"))
    none = F.lit(None)
    responses = in_place.withColumn("named", F.lit(False)).unionByName(moved.withColumn("named", F.coalesce(named, F.lit(False))).drop("f_same", "f_id", "first_url", "first_n"))
    responses = responses.select("id", "url", "bytes", sha1_base32(body).alias("digest"), F.when(~F.col("named"), F.col("nonce")).alias("nonce"), "payload", none.cast("string").alias("said"), none.cast("string").alias("refers_to"), none.cast("string").alias("refers_uri"))
    known = F.when(F.col("first.n") == 1, _urn("response", F.col("first.id"), F.col("first.url"), F.col("digest"), none))
    revisits = apart.filter(~is_first).select("id", "url", "bytes", "digest", "nonce", none.cast("string").alias("payload"), F.col("first.id").cast("string").alias("said"), known.alias("refers_to"), F.col("first.url").alias("refers_uri"))
    for kind, rows in (("response", responses), ("revisit", revisits)):
        _records(rows, kind, date).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).mode("append").text(path)


def _uri(url: Column) -> Column:
    """A WARC-Target-URI may hold no control characters or spaces; the url itself goes into the metadata."""
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")


def _records(rows: DataFrame, kind: str, date: str) -> DataFrame:
    """The three records of each row, as ``value``."""
    parts = (F.col("id"), F.col("url"), F.col("digest"), F.col("nonce"))
    rid, uri = _urn("response", *parts), _uri(F.col("url"))
    host = F.regexp_extract(uri, r"^[A-Za-z]+://([^/?#]*)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    fields = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("url").alias("url"), F.col("bytes").alias("bytes"), F.col("said").alias("refers_to")))
    request = _record("request", _urn("request", *parts), uri, date, "application/http;msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)), ("WARC-Concurrent-To", rid))
    if kind == "response":
        answer = _record(kind, rid, uri, date, "application/http;msgtype=response", F.concat(http, F.col("payload")), ("WARC-Payload-Digest", digest))
    else:
        refers = [("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To-Target-URI", _uri(F.col("refers_uri"))), ("WARC-Refers-To-Date", F.lit(date))]
        answer = _record(kind, rid, uri, date, "application/http;msgtype=response", http, ("WARC-Payload-Digest", digest), *refers, ("WARC-Refers-To", F.col("refers_to")))
    metadata = _record("metadata", _urn("metadata", *parts), uri, date, "application/warc-fields", F.concat(F.lit("capture: "), fields, F.lit(CRLF)), ("WARC-Concurrent-To", rid))
    return rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))


_RECORDS = pa.schema([("capture", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("http", pa.binary()), ("payload", pa.binary())])


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of archives given as what lies between their blank lines, in order. A record ends by its
    Content-Length, so a payload may itself look like WARC; only one record is held at a time."""
    held: list[bytes] = []
    size = need = 0
    for piece in pieces:
        held += (piece, _GAP)
        size += len(piece) + len(_GAP)
        while size >= need and size:
            raw = b"".join(held)
            if not need:  # blank lines between records say nothing; the last piece of a file may have added one
                raw = raw.lstrip(CRLF.encode())
                size = len(raw)
                if not raw:
                    held = []
                    break
            top = raw.find(_GAP)
            lines = raw[:top].decode().split(CRLF)
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record begins with {lines[0][:40]!r}")
            head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            end = top + len(_GAP) + int(head["content-length"])
            if size < end + len(_GAP):
                held, size, need = [raw], len(raw), end + len(_GAP)
                break
            if raw[end : end + len(_GAP)] != _GAP:
                raise ValueError(f"the record {head.get('warc-record-id')} has not the length that it states")
            block = raw[top + len(_GAP) : end]
            split = block.find(_GAP) + len(_GAP) if head.get("content-type", "").startswith("application/http") else 0
            rid, kind = head["warc-record-id"], head["warc-type"]
            payload = None if kind == "revisit" else block[split:]
            yield head.get("warc-concurrent-to", rid), kind, rid, head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to"), block[:split], payload
            held, size, need = [raw[end + len(_GAP) :]], size - end - len(_GAP), 0
    if size:
        raise ValueError("the last record is cut off")


_GAP = b"\r\n\r\n"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped archives in ``path``. A task reads its archives as a stream of
    what lies between blank lines, so an archive may have any length and a task holds one record."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for x in b.column(0):
                yield x.as_buffer().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for r in parse_records(pieces(batches)):
            rows.append(r)
            held += len(r[-1] or b"")
            if len(rows) == 1000 or held > BLOCK_BYTES:
                yield batch(_RECORDS, *zip(*rows, strict=True))
                rows, held = [], 0
        if rows:
            yield batch(_RECORDS, *zip(*rows, strict=True))

    lines = spark.read.option("lineSep", CRLF + CRLF).option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, _ddl(_RECORDS))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (the id of its response or revisit), ``request``,
    ``response`` and ``metadata``. Records belong together through WARC-Concurrent-To; a record that
    repeats another's id counts once, a capture without a response has a null there, and of several
    requests the one with the largest id is taken."""
    body = F.struct("record_id", "kind", "uri", "digest", "refers_to", "http", "payload")
    pick = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), body))
    return records.groupBy("capture").agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"))


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``pages`` from the archives written of it; null payloads have 0 bytes, repeated
    rows are captures of their own, an empty table gives no row."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    whole = assemble(read_records(spark, path))
    said = F.from_json(F.substring(F.col("metadata.payload").cast("string"), len("capture: ") + 1, 1 << 30), "id string, url string, bytes long, refers_to string")
    kind = pages.schema["page_id"].dataType
    payload = F.col("response.payload")
    return whole.select(said.alias("said"), "response").select(
        F.col("said.id").cast(kind).alias("page_id"),
        F.coalesce(F.octet_length(payload), F.col("said.bytes")).cast("long").alias("payload_bytes"),
        F.when(payload.isNotNull(), sha1_base32(payload)).otherwise(F.substring("response.digest", 6, 32)).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("said.refers_to").cast(kind).alias("refers_to"),
    )


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {s}) & 31)::INT + 1, 1)"
_FOUR = " || ".join(_DIGIT.format(v=f"CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER)", s=s) for k in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(body) AS payload_bytes, {_FOUR} AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
