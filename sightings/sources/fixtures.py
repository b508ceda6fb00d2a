"""Adapter views over the driver tables (FIXTURES.md): frames, boxes, class_dim, attempts, corpus,
logits, class_map, epoch_log, plus ``reviews`` (human review marks for the D-tier fact queries).

Each adapter exists twice: as a DataFrame builder (what the Spark queries run) and as SQL text (what
the DuckDB oracle runs). Both read only the columns they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values (must equal the reference): the detector's animal classes, id -> name.
ANIMAL_CLASSES = [
    (14, "bird"), (15, "cat"), (16, "dog"), (17, "horse"), (18, "sheep"),
    (19, "cow"), (20, "elephant"), (21, "bear"), (22, "zebra"), (23, "giraffe"),
]

# Fixture constants (FIXTURES.md): base epoch 2024-01-01T00:00:00Z, 2 s per order key.
BASE_EPOCH = 1704067200


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return o.select(
        F.col("o_orderkey").alias("frame_id"),
        F.concat(F.lit("cam_"), (F.col("o_orderkey") % 3).cast("string")).alias("source"),
        (F.lit(BASE_EPOCH) + F.col("o_orderkey") * 2).cast("double").alias("epoch_s"),
        (F.lit(20) + F.col("o_custkey") % 60).cast("double").alias("grab_ms"),
        (F.lit(700) + F.col("o_custkey") % 400).cast("double").alias("detect_ms"),
        (F.col("o_custkey") % 1000).cast("double").alias("classify_ms"),
    )


def class_dim(spark: SparkSession) -> DataFrame:
    """The classes as a literal relation, of which the optimizer knows the size."""
    rows = ", ".join(f"({i}, '{name}')" for i, name in ANIMAL_CLASSES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(cls_id, class_name)")


def _boxes_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_tax", "l_returnflag", "l_linestatus"],
    )
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    # Number detections by frame_id itself (not l_orderkey): the window's hash partitioning on
    # frame_id is then reused by every later per-frame aggregation and join, saving a shuffle.
    li = li.withColumnRenamed("l_orderkey", "frame_id")
    j = li.join(p, li.l_partkey == p.p_partkey)
    w = Window.partitionBy("frame_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x0 = ((F.col("l_partkey") * 7) % 1900).cast("double")
    y0 = ((F.col("l_suppkey") * 13) % 1000).cast("double")
    conf = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_suppkey")) % 129) / F.lit(128.0)
    sconf = ((F.col("l_partkey") * 53 + F.col("l_linenumber") * 7) % 129) / F.lit(128.0)
    null_sp = F.col("p_size") % 7 == 0
    return j.select(
        F.col("frame_id"),
        (F.row_number().over(w) - 1).cast("int").alias("det_idx"),
        (F.col("l_partkey") % 30).cast("int").alias("cls_id"),
        conf.cast("float").alias("confidence"),
        (x0 + F.col("l_tax")).alias("x1"),
        (y0 + F.col("l_tax")).alias("y1"),
        (x0 + 20 + F.col("l_quantity") * 4.5).alias("x2"),
        (y0 + 20 + F.col("l_quantity") * 3.5).alias("y2"),
        F.when(null_sp, F.lit(None).cast("string"))
        .when(F.col("p_size") % 11 == 0, F.lit(""))
        .otherwise(F.lower("p_type")).alias("species"),
        F.when(null_sp, F.lit(None).cast("float")).otherwise(sconf.cast("float")).alias("species_confidence"),
        (F.col("l_returnflag") == "R").alias("reviewed"),
        F.when(F.col("l_linestatus") == "O", F.lower("p_type")).alias("corrected_label"),
    )


BOX_COLS = ["frame_id", "det_idx", "cls_id", "confidence", "x1", "y1", "x2", "y2", "species", "species_confidence"]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes_ext(spark, sf_dir).select(*BOX_COLS)


def reviewed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes plus their review marks (one adapter pass)."""
    return _boxes_ext(spark, sf_dir)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review marks keyed like boxes: lines with return flag R are reviewed; open lines carry a
    corrected label (the part type), closed ones confirm the prediction (null)."""
    return _boxes_ext(spark, sf_dir).select("frame_id", "det_idx", "reviewed", "corrected_label")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    return e.select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("cam_"), (F.col("user_id") % 10).cast("string")).alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("ok"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    cls = F.concat(F.col("lang"), F.lit("_"), F.col("source"))
    ext = F.when(F.col("doc_id") % 3 == 0, ".jpg").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".txt")
    return d.select(
        cls.alias("class_name"),
        F.concat(F.lit("root/"), cls, F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return e.select("vec_id", F.col("embedding").alias("logits"), "label")


def class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part", ["p_partkey"])
    return (
        p.where(F.col("p_partkey") < 60)
        .select(F.col("p_partkey").cast("int").alias("idx"),
                F.concat(F.lit("species_"), F.col("p_partkey").cast("string")).alias("class_name"))
        .distinct()
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation", ["n_nationkey"])
    return n.select(
        F.col("n_nationkey").cast("int").alias("epoch"),
        (((F.col("n_nationkey") * 37) % 17).cast("double") * 5.0).alias("val_acc"),
    )


# ---- the same adapters as SQL (DuckDB oracle; also valid Spark SQL) -------------------------

SQL = {
    "frames": """SELECT o_orderkey AS frame_id,
       concat('cam_', CAST(o_orderkey % 3 AS VARCHAR(8))) AS source,
       CAST(1704067200 + o_orderkey * 2 AS DOUBLE) AS epoch_s,
       CAST(20 + o_custkey % 60 AS DOUBLE) AS grab_ms,
       CAST(700 + o_custkey % 400 AS DOUBLE) AS detect_ms,
       CAST(o_custkey % 1000 AS DOUBLE) AS classify_ms
FROM orders""",
    "class_dim": """SELECT * FROM (VALUES (14,'bird'),(15,'cat'),(16,'dog'),(17,'horse'),(18,'sheep'),
  (19,'cow'),(20,'elephant'),(21,'bear'),(22,'zebra'),(23,'giraffe')) AS t(cls_id, class_name)""",
    "boxes_ext": """SELECT l_orderkey AS frame_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS det_idx,
  CAST(l_partkey % 30 AS INT) AS cls_id,
  CAST(((l_partkey*37 + l_linenumber*11 + l_suppkey) % 129) / CAST(128 AS DOUBLE) AS FLOAT) AS confidence,
  CAST((l_partkey*7) % 1900 AS DOUBLE) + l_tax AS x1,
  CAST((l_suppkey*13) % 1000 AS DOUBLE) + l_tax AS y1,
  CAST((l_partkey*7) % 1900 AS DOUBLE) + 20 + l_quantity*4.5 AS x2,
  CAST((l_suppkey*13) % 1000 AS DOUBLE) + 20 + l_quantity*3.5 AS y2,
  CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '' ELSE lower(p_type) END AS species,
  CASE WHEN p_size % 7 = 0 THEN NULL
       ELSE CAST(((l_partkey*53 + l_linenumber*7) % 129) / CAST(128 AS DOUBLE) AS FLOAT) END AS species_confidence,
  l_returnflag = 'R' AS reviewed,
  CASE WHEN l_linestatus = 'O' THEN lower(p_type) END AS corrected_label
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "boxes": """SELECT frame_id, det_idx, cls_id, confidence, x1, y1, x2, y2, species, species_confidence
FROM boxes_ext""",
    "reviews": "SELECT frame_id, det_idx, reviewed, corrected_label FROM boxes_ext",
    "attempts": """SELECT event_id AS attempt_id, concat('cam_', CAST(user_id % 10 AS VARCHAR(8))) AS source, ts,
       event_type <> 'error' AS ok
FROM events""",
    "corpus": """SELECT concat(lang, '_', source) AS class_name,
       concat('root/', lang, '_', source, '/', CAST(doc_id AS VARCHAR(20)),
              CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.txt' END) AS path
FROM documents""",
    "logits": "SELECT vec_id, embedding AS logits, label FROM embeddings",
    "class_map": """SELECT DISTINCT CAST(p_partkey AS INT) AS idx, concat('species_', CAST(p_partkey AS VARCHAR(8))) AS class_name
FROM part WHERE p_partkey < 60""",
    "epoch_log": """SELECT CAST(n_nationkey AS INT) AS epoch, CAST((n_nationkey * 37) % 17 AS DOUBLE) * 5.0 AS val_acc FROM nation""",
}

_DEPENDS = {"boxes": ["boxes_ext"], "reviews": ["boxes_ext"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """A ``WITH`` clause defining the named adapters (and what they depend on), in order."""
    ordered: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in ordered) + "\n"
