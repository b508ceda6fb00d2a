"""WARC archives and the monolithic gzip normaliser (operator 3).

``write_monolithic`` writes pages as WARC records the way careless crawlers do: each file one gzip
stream around all of its records, so nothing can be read without inflating what lies before it.
``normalise`` inflates each such file once, front to back, and rewrites every record as a gzip
member of its own, with a sidecar index of the members' offsets. ``read_archives`` walks the members
of normalised archives; ``read_records`` fetches single records by the index.

Equal payloads of at least ``MIN_BYTES`` are stored once: the record with the largest page_id is the
response, the others are revisits of it. That needs only a map-side combined maximum by digest.
Files are read and written by Spark alone, so any store that Spark reaches will do. A file holds
about ``ARCHIVE_BYTES`` of payload, and one file at a time is in a task's memory.

Rules for odd rows: a null html is an empty payload; null page_ids and urls leave their header out
and read back as null; page_ids on several rows with the same payload are all responses if they hold
the largest id; payloads whose ids are all null are all responses; line breaks in urls are
percent-encoded; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import scratch_path, stage

MIN_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
_END = "\r\n\r\n"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for each page."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    # only payloads that occur more than once need the exchange of the largest id
    # (staged, so that the planner knows their size and moves the payloads only if they are many)
    twice = stage(rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
                  .agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).filter("copies > 1"), "warc-twice")
    named = twice.select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "response")
    joined = rows.join(named, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.coalesce(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.lit(False))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def _record_text():
    """Column: a whole WARC record but for its closing blank line."""
    def header(name: str, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def urn(c: str):
        return F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))

    is_response = F.col("record_type") == "response"
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", urn("page_id")),
        header("WARC-Target-URI", url), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")), header("WARC-Refers-To", urn("refers_to")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(is_response, F.col("payload_bytes")).otherwise(0).cast("string"), F.lit(_END),
        F.when(is_response, F.col("payload")).otherwise(""))


def write_monolithic(recs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One gzip stream a file, each record closed by a blank line.

    The text writer puts its separator after each row, which is that blank line. Files are cut at so
    many records that they hold about ``archive_bytes`` of payload."""
    size = recs.agg(F.avg("payload_bytes")).first()[0] or 1
    (recs.select(_record_text().alias("value")).write.option("lineSep", _END).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(archive_bytes / max(size, 1)))).text(path))


class _Inflated:
    """A gzip file's bytes, in order, inflated as they are asked for (members or one stream)."""

    def __init__(self, raw: bytes, step: int = 1 << 18):
        self.raw, self.at, self.step = raw, 0, step
        self.unzip = zlib.decompressobj(31)
        self.buf = bytearray()

    def _more(self) -> bool:
        if self.unzip.eof:
            rest = self.unzip.unused_data
            self.at -= len(rest)
            if self.at >= len(self.raw) or not self.raw[self.at:self.at + 1].strip(b"\0"):
                return False
            self.unzip = zlib.decompressobj(31)
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at:self.at + self.step]
        self.at += len(piece)
        self.buf += self.unzip.decompress(piece)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with ``mark``; None at the end."""
        start = 0
        while (k := self.buf.find(mark, start)) < 0:
            start = max(0, len(self.buf) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers in lower case, the head as it is, payload) of each record of a gzipped archive."""
    stream = _Inflated(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        body = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record isn't closed by a blank line")
        yield fields, head, body


def _member(record: bytes) -> bytes:
    zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zip_.compress(record) + zip_.flush()


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _page(urn: str | None) -> int | None:
    """The page of a record written here; None for records of other archives."""
    found = _PAGE.fullmatch(urn or "")
    return int(found[1]) if found else None


def archive_name(path: str) -> str:
    """A folder name for an archive: its file name without ending, and a mark of the whole path, as names repeat."""
    stem = re.sub(r"(\.warc)?\.gz$", "", path.rsplit("/", 1)[-1])
    return f"{re.sub(r'[^A-Za-z0-9._-]', '_', stem)}-{hashlib.sha1(path.encode()).hexdigest()[:10]}"


def _facts(fields: dict[str, str], body: bytes) -> dict:
    """What a record says: of responses measured on the payload, of revisits as the headers have it. A response of
    ours must have its digest; records of other archives (any id, any type) have no page, and are measured whole."""
    kind, page = fields["warc-type"], _page(fields.get("warc-record-id"))
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest = said if kind == "revisit" else hashlib.sha1(body).hexdigest()
    if kind == "response" and page is not None and digest != said:
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
    size = int(fields.get("warc-payload-length", len(body))) if kind == "revisit" else len(body)
    return {"page_id": page, "payload_digest": digest, "record_type": kind, "payload_bytes": size,
            "refers_to": _page(fields.get("warc-refers-to")), "record_id": fields.get("warc-record-id")}


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def normalise(spark: SparkSession, source: str, target: str) -> tuple[str, str]:
    """Rewrite each gzip file below ``source``; returns the folders of the archives and the index.

    An archive is the file in ``archive=<name>``, its name taken from the source file's path (``archive_name``). The
    sidecar index (Parquet, in a folder of the same name) has page_id (null for records of other archives),
    record_id, record_type, offset and length of every member. Both come from one pass over the source."""
    kind = ("archive string, content binary, "
            "entries array<struct<page_id:bigint,record_id:string,record_type:string,offset:bigint,length:bigint>>")
    entry = pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                                ("offset", pa.int64()), ("length", pa.int64())]))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b["path"].to_pylist(), b["content"]):
                out, entries = bytearray(), []
                for fields, head, body in parse(raw.as_py()):
                    member = _member(head + body + b"\r\n\r\n")
                    entries.append({"page_id": _page(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"),
                                    "record_type": fields["warc-type"],
                                    "offset": len(out), "length": len(member)})
                    out += member
                if entries:
                    yield pa.RecordBatch.from_arrays([pa.array([archive_name(path)]), pa.array([bytes(out)], pa.binary()), pa.array([entries], entry)],
                                                     names=["archive", "content", "entries"])

    made = _binary(spark, source).select("path", "content").mapInArrow(rewrite, kind)
    packed = f"{target}/packed"
    made.write.option("compression", "none").parquet(packed)
    made = spark.read.schema(kind).parquet(packed)
    archives, index = f"{target}/archives", f"{target}/index"
    # bytes pass a string column unchanged; the writer closes the file with its separator, a zero byte, which gzip readers skip
    (made.select("archive", F.col("content").cast("string").alias("value")).write.partitionBy("archive")
     .option("lineSep", "\u0000").option("compression", "none").text(archives))
    made.select("archive", F.inline("entries")).write.partitionBy("archive").parquet(index)
    return archives, index


def read_archives(spark: SparkSession, archives: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and record_id of every record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["content"]:
                rows = [_facts(fields, body) for fields, _, body in parse(raw.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return _binary(spark, archives).select("content").mapInArrow(read, f"{_RECORD}, record_id string")


def read_records(spark: SparkSession, archives: str, index: str, page_ids: DataFrame) -> DataFrame:
    """(page_id, payload) of the stored responses among ``page_ids``, each member inflated alone."""
    wanted = spark.read.parquet(index).filter("record_type = 'response'").join(page_ids.select("page_id").distinct(), "page_id")
    spots = wanted.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("spots"))
    files = _binary(spark, archives).select(F.col("archive").cast("string").alias("archive"), "content")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, spots_ in zip(b["content"], b["spots"].to_pylist()):
                data = raw.as_py()
                found = [next(parse(data[s["offset"]:s["offset"] + s["length"]])) for s in spots_]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_page(f.get("warc-record-id")) for f, _, _ in found], pa.int64()),
                     pa.array([body.decode("utf-8") for _, _, body in found], pa.string())], names=["page_id", "payload"])

    return files.join(spots, "archive").select("content", "spots").mapInArrow(fetch, "page_id bigint, payload string")


def op3(pages: DataFrame) -> DataFrame:
    """Write the pages, normalise the archives, read them back."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    write_monolithic(records(pages), f"{root}/crawl")
    archives, _ = normalise(spark, f"{root}/crawl", f"{root}/normal")
    return read_archives(spark, archives).drop("record_id")


OP3_SQL = f"""
WITH r AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM r)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""
