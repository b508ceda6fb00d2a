"""FIXTURES.md anchor values at sf0.01."""

from pyspark.sql import functions as F

from sightings.operators import alerts as AL
from sightings.operators import corpus as CO
from sightings.operators import detections as D
from sightings.operators import vectors as VE
from sightings.plans import catalog as C
from sightings.sources import fixtures as X
from tests.conftest import SF01


def test_frames_and_boxes(spark):
    f = X.frames(spark, SF01).agg(F.count("*"), F.sum("epoch_s")).first()
    assert (f[0], f[1]) == (15000, 25561232985000)
    b = X.boxes(spark, SF01).agg(
        F.count("*"), F.sum("confidence"), F.sum("species_confidence"),
        F.sum(F.col("species").isNull().cast("int")), F.sum((F.col("species") == "").cast("int"))).first()
    assert b[0] == 60000 and abs(b[1] - 30051.90625) < 1e-6 and abs(b[2] - 25772.4765625) < 1e-6
    assert (b[3], b[4]) == (8463, 5070)


def test_detections_best_and_crops(spark):
    dets = C.kept_detections(spark, SF01)
    assert dets.count() == 15043
    assert dets.select("frame_id").distinct().count() == 9503
    assert D.frames_without_detections(X.frames(spark, SF01), dets).count() == 5497
    best = D.best_species(dets).agg(F.count("*"), F.sum("frame_id"), F.countDistinct("best_species"),
                                    F.sum("best_species_conf")).first()
    assert (best[0], best[1], best[2]) == (8158, 61458738, 6) and abs(best[3] - 4587.8671875) < 1e-6
    cw = D.crop_window(dets, 1920, 1080)
    # clamped = the padded window left the frame on some side
    clamped = cw.where((F.col("bbox_x1") - 100 < 0) | (F.col("bbox_y1") - 100 < 0) | (F.col("bbox_x2") + 100 > 1920)
                       | (F.col("bbox_y2") + 100 > 1080)).count()
    assert clamped == 5724


def test_failure_runs(spark):
    r = AL.failure_runs(X.attempts(spark, SF01)).agg(
        F.count("*"), F.max("fail_n"), F.sum("backoff_s")).first()
    assert (r[0], r[1]) == (2014, 5) and abs(r[2] - 501.4) < 1e-9


def test_changes_and_announce(spark):
    bf = C.frames_with_best(spark, SF01)
    ch = AL.species_changes(bf, 0.5)
    assert ch.count() == 4869 and ch.where("changed").count() == 4071
    a = AL.announce(bf, 0.5).agg(
        F.count("*"), F.sum(F.col("speak").cast("int")), F.sum(F.col("play_song").cast("int"))).first()
    assert tuple(a) == (4869, 4109, 4617)


def test_visits(spark):
    assert AL.species_visits(C.frames_with_best(spark, SF01), 30.0, 0.5).count() == 4189


def test_corpus_and_vectors(spark):
    counts = CO.class_counts(X.corpus(spark, SF01))
    valid = CO.valid_classes(counts, 5)
    assert counts.count() == 80 and valid.count() == 44
    assert valid.agg(F.sum("n")).first()[0] == 567
    assert X.logits(spark, SF01).count() == 500 and X.class_map(spark, SF01).count() == 60
    assert VE.best_epochs(X.epoch_log(spark, SF01)).count() == 6
