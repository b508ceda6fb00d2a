"""File sources: frames from image files (S1), labelled corpora (S2), the sightings fact table
(S4, Parquet or JDBC) and the class mapping document (S5)."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


FRAME_COLUMNS = ("path", "image", "source", "frame_id", "scheduled_at", "epoch_s", "grab_ms", "reason")
_FRAME_TIME = r"frame_([0-9]{8}_[0-9]{6})[^/]*$"


def with_frame_identity(img: DataFrame, source: str | None = None) -> DataFrame:
    """Image rows as frames: ``source`` (given, or the folder the file is in), ``frame_id`` (hash of the
    path), ``scheduled_at`` / ``epoch_s`` (the time in a name ``frame_yyyyMMdd_HHmmss``, else when the
    file was written), ``grab_ms`` (null: a file isn't grabbed) and ``reason`` (null if decoded)."""
    path = F.col("image.origin")
    named = F.try_to_timestamp(F.regexp_extract(path, _FRAME_TIME, 1), F.lit("yyyyMMdd_HHmmss"))
    when = F.coalesce(named, F.col("_metadata.file_modification_time"))
    bad = F.col("image").isNull() | (F.col("image.height") <= 0)
    return img.select(
        path.alias("path"), "image",
        (F.lit(source) if source is not None else F.element_at(F.split(path, "/"), -2)).alias("source"),
        F.xxhash64(path).alias("frame_id"), when.alias("scheduled_at"),
        (F.unix_micros(when) / F.lit(1_000_000.0)).cast("double").alias("epoch_s"), F.lit(None).cast("double").alias("grab_ms"),
        F.when(F.coalesce(bad, F.lit(True)), F.concat(
            F.lit("decode failed ("), F.col("_metadata.file_size").cast("string"), F.lit(" bytes)"))).alias("reason"))


def scan_frames(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """S1 in one scan: every image file as a frame, undecodable ones with a ``reason``."""
    return with_frame_identity(spark.read.format("image").option("dropInvalid", False).load(path), source)


def read_frames(spark: SparkSession, path: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(frames, rejects)`` of ``scan_frames``; an undecodable file becomes a reject
    ``decode failed (<n> bytes)`` and never stops the scan. Zero-byte files are not listed by Spark's
    file sources, so "empty response" can only come from an attempts table. A job that needs both
    sides should keep ``scan_frames`` and split what it has written."""
    seen = scan_frames(spark, path, source)
    return seen.where(F.col("reason").isNull()).drop("reason"), \
        seen.where(F.col("reason").isNotNull()).select("path", "source", "scheduled_at", "reason")


def store_frames(frames: DataFrame, table: str, path: str | None = None, buckets: int = 64) -> DataFrame:
    """Frames as a table bucketed by frame_id: joins on frame_id (M7, M10) then read the pixels where they lie, and only
    the narrow side is shuffled. ``path`` makes it an external table. Take at least as many buckets as joins have
    shuffle partitions, else Spark prefers to deal the pixels anew."""
    w = frames.write.mode("overwrite").format("parquet").bucketBy(buckets, "frame_id").sortBy("frame_id")
    (w.option("path", path) if path else w).saveAsTable(table)
    return frames.sparkSession.table(table)


def read_labelled_images(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """One row per ``<root>/<class>/<file>.jpg|.png`` (depth exactly 2, lower-case suffix);
    the class is the parent directory. File bytes are only read when ``with_content``."""
    df = spark.read.format("binaryFile").load(root.rstrip("/") + "/*/*.{jpg,png}")
    cols = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    return df.select(*cols).withColumn("class_name", F.element_at(F.split("path", "/"), -2))


def list_class_dirs(spark: SparkSession, root: str) -> DataFrame:
    """Class directories under ``root`` (including empty ones, which a file scan cannot see).

    A directory listing on the driver: one entry per class directory.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    names = sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())
    return spark.createDataFrame([(n,) for n in names], "class_name string")


def read_class_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``idx_to_class`` of a mapping document -> (idx INT, class_name). A missing key gives an
    empty table."""
    doc = spark.read.text(path, wholetext=True)
    m = doc.select(F.from_json("value", "struct<idx_to_class: map<string,string>>").alias("d"))
    return m.select(F.explode(F.coalesce(F.col("d.idx_to_class"), F.create_map().cast("map<string,string>")))) \
        .select(F.col("key").cast("int").alias("idx"), F.col("value").alias("class_name"))


def _from_dsn(dsn: str) -> dict[str, str]:
    """JDBC options of a database URL: user and password leave the URL, all else stays."""
    if dsn.startswith("jdbc:"):
        return {"url": dsn}
    parts = urlsplit(dsn)
    host = parts.hostname or ""
    host = f"[{host}]" if ":" in host else host
    url = f"jdbc:postgresql://{host}{f':{parts.port}' if parts.port else ''}{parts.path}"
    opts = {"url": url + (f"?{parts.query}" if parts.query else "")}
    for name, value in (("user", parts.username), ("password", parts.password)):
        if value is not None:
            opts[name] = unquote(value)
    return opts


def _whole_number(text: str | None) -> str | None:
    t = (text or "").strip()
    return str(int(t)) if t.isdecimal() else None


def jdbc_options(settings: Mapping[str, str | None], table: str) -> dict[str, str]:
    """S4 connection options from env-style settings. ``DATABASE_URL`` wins; otherwise PGHOST,
    PGDATABASE and PGUSER are required, PGPORT / PGCONNECT_TIMEOUT parse leniently (invalid ->
    unset), PGPASSWORD / PGSSLMODE are optional. The table name must be a safe identifier."""
    opts: dict[str, str] = {"dbtable": S.safe_identifier(table), "driver": "org.postgresql.Driver"}
    if settings.get("DATABASE_URL"):
        return opts | _from_dsn(settings["DATABASE_URL"])
    host, database, user = (settings.get(k) or "" for k in ("PGHOST", "PGDATABASE", "PGUSER"))
    if not (host and database and user):
        unset = [k for k, v in (("PGHOST", host), ("PGDATABASE", database), ("PGUSER", user)) if not v]
        raise ValueError(f"no database to connect to: {' and '.join(unset)} not set, nor DATABASE_URL")
    port, timeout = _whole_number(settings.get("PGPORT")), _whole_number(settings.get("PGCONNECT_TIMEOUT"))
    params = {"ApplicationName": settings.get("PGAPPLICATION_NAME") or "sightings",
              "sslmode": settings.get("PGSSLMODE"), "connectTimeout": timeout}
    query = "&".join(f"{k}={quote(v)}" for k, v in params.items() if v)
    opts |= {"url": f"jdbc:postgresql://{host}{f':{port}' if port else ''}/{database}?{query}", "user": user}
    if settings.get("PGPASSWORD") is not None:
        opts["password"] = settings["PGPASSWORD"]
    return opts


def read_sightings(spark: SparkSession, path: str | None = None, *, jdbc: Mapping[str, str] | None = None,
                   bounds: tuple[str, str] | None = None, partitions: int = 64) -> DataFrame:
    """The fact table from Parquet (partitioned by ``detected_date``, so time filters prune
    directories) or over JDBC, read in parallel slices of ``detected_at`` when bounds are given."""
    if path is not None:
        return spark.read.parquet(path)
    assert jdbc is not None, "give a path or JDBC options"
    r = spark.read.format("jdbc").options(**jdbc)
    if bounds is not None:
        r = r.option("partitionColumn", "detected_at").option("lowerBound", bounds[0]) \
            .option("upperBound", bounds[1]).option("numPartitions", str(partitions))
    return r.load()
