import gzip
import hashlib
import os
import zlib

from pyspark.sql import functions as F

from sightings.llm import warc
from sightings.llm.common import scratch_path

SCHEMA = "page_id bigint, url string, html string"


def fixture():
    big = "<p>" + "größe " * 300 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(k, f"http://h/{k}", f"<html>{k}" + "x" * (k * 37)) for k in range(60)]
    rows += [(100 + k, "http://copy/\r\nSet: 1", big) for k in range(40)] + [(500, None, None), (501, "", ""), (502, "u", "short"), (503, "u", "short")]
    rows += [(None, "n", "y" * 2000), (None, "n", "z" * 2000), (7, "z", "z" * 2000), (139, "again", big)]
    return rows + [(600, "exact", "a" * 1000), (601, "exact", "a" * 1000), (602, "less", "b" * 999), (603, "less", "b" * 999)]


def brute(rows):
    out, largest = [], {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if p is not None:
            largest[raw] = max(p, largest.get(raw, p))
    for p, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and raw in largest and p != largest[raw]
        out.append((str(p), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(largest[raw] if revisit else None)))
    return sorted(out)


def result(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


def test_round_trip_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("payload", F.lit("clash"))
    assert result(warc.op3(df)) == brute(rows)


def _files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names if not f.startswith((".", "_"))]


def test_members_index_and_random_access(spark):
    rows = fixture()
    root = scratch_path(spark, "warc-test")
    recs = warc.records(spark.createDataFrame(rows, SCHEMA).repartition(2))
    warc.write_monolithic(recs, f"{root}/crawl", archive_bytes=20_000)
    crawl = _files(f"{root}/crawl")
    assert len(crawl) > 2
    for f in crawl:  # one member around all records
        raw = open(f, "rb").read()
        z = zlib.decompressobj(31)
        z.decompress(raw)
        assert z.eof and not z.unused_data
    archives, index = warc.normalise(spark, f"{root}/crawl", f"{root}/normal")
    files = {os.path.basename(os.path.dirname(f)).removeprefix("archive="): f for f in _files(archives)}
    entries = spark.read.parquet(index).collect()
    assert len(entries) == len(rows) and set(files) == {r.archive for r in entries}
    for r in entries:  # each record is a member of its own, found by its offset
        raw = open(files[r.archive], "rb").read()[r.offset:r.offset + r.length]
        z = zlib.decompressobj(31)
        text = z.decompress(raw)
        assert z.eof and not z.unused_data and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    for f in files.values():
        assert gzip.open(f).read().count(b"WARC-Type: ") > 0
    ids = spark.createDataFrame([(3,), (55,), (500,), (139,), (9999,)], "page_id bigint")
    got = {r.page_id: r.payload for r in warc.read_records(spark, archives, index, ids).collect()}
    assert got == {3: rows[3][2], 55: rows[55][2], 500: "", 139: rows[60][2]}


def test_empty_table(spark):
    assert warc.op3(spark.createDataFrame([], SCHEMA)).count() == 0


def foreign(kind, body, name, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Any record id and type, and equal base names in several folders."""
    sets = {}
    for folder, name in (("a", "crawl.1.warc.gz"), ("a", "crawl.2.warc.gz"), ("b", "crawl.1.warc.gz")):
        recs = [foreign("warcinfo", b"software: x", f"{folder}{name}0"),
                foreign("request", b"GET / HTTP/1.1\r\n\r\n", f"{folder}{name}1"),
                foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + folder.encode() * 50, f"{folder}{name}2", "WARC-Payload-Digest: sha1:ABCDEFG\r\n"),
                foreign("metadata", b"", f"{folder}{name}3")]
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_bytes(gzip.compress(b"".join(recs)))
        sets[folder, name] = recs
    archives, index = warc.normalise(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"))
    entries = spark.read.parquet(index).collect()
    assert len(entries) == 12 and len({r.archive for r in entries}) == 3 and len({r.record_id for r in entries}) == 12
    files = {os.path.basename(os.path.dirname(f)).removeprefix("archive="): f for f in _files(archives)}
    members = sorted(gzip.decompress(open(files[r.archive], "rb").read()[r.offset:r.offset + r.length]) for r in entries)
    assert members == sorted(x for recs in sets.values() for x in recs)
    got = warc.read_archives(spark, archives).collect()
    assert sorted(r.record_type for r in got) == sorted(["warcinfo", "request", "response", "metadata"] * 3) and all(r.page_id is None for r in got)
