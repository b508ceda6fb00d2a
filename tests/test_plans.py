"""Physical-plan properties the operators rely on at scale (checked with explain)."""

import io
import os
import tempfile
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from sightings.operators import corpus as CO
from sightings.operators import detections as D
from sightings.operators import facts as FA
from sightings.plans import catalog as C
from sightings.sources import fixtures as X
from tests.conftest import SF01


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_class_join_is_broadcast_by_its_size(spark):
    p = plan(D.filter_classes(X.boxes(spark, SF01), X.class_dim(spark)))
    assert "BroadcastHashJoin" in p


def test_confidence_filter_and_columns_reach_parquet(spark):
    d = tempfile.mkdtemp(prefix="sightings-plan-")
    X.boxes(spark, SF01).write.mode("overwrite").parquet(d + "/boxes")
    stored = spark.read.parquet(d + "/boxes")
    p = plan(D.filter_confidence(stored).select("frame_id", "confidence"))
    assert "PushedFilters: [IsNotNull(confidence), GreaterThan(confidence,0.25)]" in p
    assert "ReadSchema: struct<frame_id:bigint,confidence:float>" in p


def test_best_species_is_partial_aggregation(spark):
    # max(struct) with a string field runs as a (sort-based) aggregate, still combined map-side
    p = plan(D.best_species(C.kept_detections(spark, SF01)))
    assert "partial_max" in p
    # no sort-based window on frame_id for the arg-max (only the fixture's own det_idx numbering)
    assert p.count("Window (") == 1


def test_corpus_scan_prunes_text(spark):
    p = plan(CO.class_counts(X.corpus(spark, SF01)))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in p


def test_time_range_prunes_date_partitions(spark):
    d = tempfile.mkdtemp(prefix="sightings-facts-")
    facts = C.sightings(spark, SF01).withColumn("detected_date", F.to_date("detected_at"))
    facts.write.mode("overwrite").partitionBy("detected_date").parquet(d)
    p = plan(FA.between(spark.read.parquet(d), "2024-01-01 06:00:00", "2024-01-01 12:00:00"))
    assert "PartitionFilters: [isnotnull(detected_date" in p


def test_labelled_image_scan_does_not_read_bytes(spark):
    root = tempfile.mkdtemp(prefix="sightings-s2-")
    os.makedirs(os.path.join(root, "wren"))
    with open(os.path.join(root, "wren", "a.jpg"), "wb") as fh:
        fh.write(b"x")
    from sightings.sources import files as FS
    p = plan(FS.read_labelled_images(spark, root))
    assert "content" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from sightings import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
    assert session.is_local_master("local[8]") and not session.is_local_master("local-cluster[3,2,1024]")


def test_events_are_parsed_once(spark):
    from sightings.operators import events as EV
    events, rejects = EV.read_events(spark.createDataFrame([("{}",)], "value string"))
    for side in (events.select("event_id", "ts", "detections"), rejects):
        assert side._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_species_by_time_rolls_up_hourly_rows(spark):
    p = plan(FA.species_by_time(C.sightings(spark, SF01)))
    assert p.count("Expand") <= 2 and p.index("partial_count(1)") > 0  # one Expand, listed in the tree and below it
