"""Global positions in ranges, and size-checked broadcasts."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightings.operators import detections as D
from sightings.operators import facts as FA
from sightings.operators import vectors as VE
from sightings.plans.ranges import ranked
from sightings.plans.sizes import sized_broadcast
from sightings.sources import fixtures as X
from tests.conftest import SF01


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_positions_equal_a_global_window(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 0.5, 0.5, rnd.random()]), rnd.choice(["a", None, "b"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, v double, s string").repartition(7)
    got = {r.id: r.at for r in ranked(df, ["v", F.col("s").desc_nulls_first(), "id"], "at").collect()}
    w = Window.orderBy(F.col("v"), F.col("s").desc_nulls_first(), F.col("id"))
    assert got == {r.id: r.at for r in df.withColumn("at", F.row_number().over(w) - 1).collect()}
    assert ranked(df.where("false"), ["v"]).collect() == []


def test_review_positions_stand_in_one_task_by_range_only(spark):
    """1,000 cameras with spread confidences: the window without a key sees one row a range."""
    facts = spark.range(200_000).select(
        F.concat(F.lit("cam_"), (F.col("id") % 1000).cast("string")).alias("source"), F.col("id").alias("frame_id"), F.lit(0).alias("det_idx"),
        (F.xxhash64("id") % 100_000 / 100_000.0).cast("float").alias("classifier_confidence"), F.lit(False).alias("reviewed"))
    out = FA.review_positions(facts)
    single = [n for n in re.findall(r"Exchange SinglePartition.*?ShuffleQueryStage.*?rowCount=(\d+)", final_plan(out), re.S)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats = out._jdf.queryExecution().optimizedPlan().toString()
    window = stats[stats.index("Window "):]
    assert "Aggregate [__part" in window and all(int(n) <= parts for n in single)
    rows = out.select("queue_pos").agg(F.min("queue_pos"), F.max("queue_pos"), F.count_distinct("queue_pos")).first()
    assert tuple(rows) == (1, 200_000, 200_000)
    check = out.withColumn("p", F.lag("classifier_confidence").over(Window.partitionBy(F.floor(F.col("queue_pos") / 5000)).orderBy("queue_pos")))
    assert check.where("p > classifier_confidence").count() == 0


def test_batches_of_any_key(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i) for i in range(100)], "name string, v int").repartition(5)
    got = {r.name: r.batch_id for r in VE.batch_ids(df, ["name"], 16).collect()}
    assert got == {f"k{i:04d}": i // 16 for i in range(100)}


def test_dimension_without_statistics_is_counted_then_broadcast(spark, tmp_path):
    X.boxes(spark, SF01).write.parquet(str(tmp_path / "boxes"))
    stored = spark.read.parquet(str(tmp_path / "boxes"))
    unknown = spark.createDataFrame(X.ANIMAL_CLASSES, "cls_id INT, class_name STRING")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # the stored boxes are larger
        for dim in (unknown, X.class_dim(spark)):
            plan = final_plan(D.filter_classes(stored, dim).groupBy("detector_label").count())
            assert "BroadcastHashJoin" in plan and "BuildRight" in plan and not re.search(r"hashpartitioning\(cls_id", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_large_dimension_is_not_hinted(spark):
    big = spark.createDataFrame([(i, f"c{i}") for i in range(2000)], "cls_id INT, class_name STRING")
    assert "ResolvedHint" in sized_broadcast(big)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in sized_broadcast(big, max_rows=1999)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in sized_broadcast(big, max_bytes=1000)._jdf.queryExecution().analyzed().toString()
    small = spark.range(10)  # statistics are known: left to Spark
    assert "ResolvedHint" not in sized_broadcast(small)._jdf.queryExecution().analyzed().toString()
