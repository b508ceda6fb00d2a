"""M3 batch inference, M8 two-stage job, M5/M6 training and evaluation."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from sightings.operators import inference as INF
from sightings.operators import training as TR
from sightings.sources import files as FS
from sightings.sources import fixtures as X
from tests.conftest import SF01
from tests.pngs import fixture_images


def _linear(tmp, d_in, n_cls, seed=0):
    rnd = np.random.default_rng(seed)
    path = os.path.join(tmp, "lin.npz")
    np.savez(path, W=rnd.normal(size=(n_cls, d_in)).astype(np.float32), b=rnd.normal(size=n_cls).astype(np.float32))
    return path


def test_predict_matches_numpy(spark):
    tmp = tempfile.mkdtemp(prefix="sightings-ml-")
    path = _linear(tmp, 64, 5)
    df = X.logits(spark, SF01).select("vec_id", F.col("logits").alias("tensor"))
    out = INF.predict(df, INF.numpy_linear_factory(path), "lin").orderBy("vec_id").collect()
    z = np.load(path)
    for r in out[:20]:
        want = np.asarray(r["tensor"], dtype=np.float32) @ z["W"].T + z["b"]
        assert np.allclose(r["logits"], want, atol=1e-4)
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, tensor array<float>")
    assert [r["logits"] for r in INF.predict(bad, INF.numpy_linear_factory(path), "lin").collect()] == [None, None]


def _fake_detector():
    # two boxes per frame: one bird (14) and one non-animal class (3) that J1 drops
    return lambda a: [(14, 0.9, 5.0, 6.0, 30.0, 25.0), (3, 0.8, 1.0, 1.0, 4.0, 4.0), (15, 0.2, 0, 0, 9, 9)]


def test_two_stage(spark):
    d = tempfile.mkdtemp(prefix="sightings-m8-")
    for name, data in fixture_images().items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    frames, _ = FS.read_frames(spark, d)
    frames = frames.withColumn("frame_id", F.xxhash64("path"))
    lin = _linear(d, 3 * 16 * 16, 4, seed=1)
    cm = spark.createDataFrame([(0, "wren"), (1, "jay")], "idx int, class_name string")
    dets, best = INF.two_stage(frames, X.class_dim(spark), _fake_detector, "fake", INF.numpy_linear_factory(lin),
                               "lin16", cm, size=16)
    rows = dets.collect()
    # 6 decodable frames, flat.png and band_35.png are corrupt -> 4 frames, one kept bird box each
    assert len(rows) == 4 and {r["detector_label"] for r in rows} == {"bird"}
    assert all(r["species"] is not None and 0 < r["species_confidence"] <= 1 for r in rows)
    assert best.count() == 4


def test_two_stage_runs_models_once_and_keeps_reasons(spark):
    d = tempfile.mkdtemp(prefix="sightings-m8c-")
    for name, data in fixture_images().items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    calls = tempfile.mkdtemp(prefix="sightings-m8calls-")

    def counting():
        def detect(a):
            with open(os.path.join(calls, "calls"), "a") as fh:
                fh.write("x")
            if a[0, 0, 0] % 2:
                raise RuntimeError("no luck")
            return [(14, 0.9, 5.0, 6.0, 30.0, 25.0), (14, 0.1, 1, 1, 2, 2)]
        return detect

    def broken():
        def classify(x):
            raise ValueError("bad input")
        return classify

    frames = FS.scan_frames(spark, d)
    dets, best, seen = INF.run_two_stage(frames, X.class_dim(spark), counting, "counting", broken, "broken", size=8, keep_crops=True)
    for _ in range(3):  # however many sinks read it
        rows, table = dets.collect(), seen.collect()
        best.count()
    good = [r for r in table if not r.is_corrupt]
    assert len(table) == frames.count() and len(open(os.path.join(calls, "calls")).read()) == len(good)
    assert {r.reason for r in table if r.is_corrupt} and all(r.reason for r in table if r.is_corrupt)
    failed = [r for r in good if r.error]
    assert all(r.error == "detector: RuntimeError: no luck" and r.detections == 0 for r in failed)
    assert all(r.detect_ms >= 0 and r.detections == 1 for r in good if not r.error)
    assert len(rows) == len(good) - len(failed)
    for r in rows:
        assert r.species is None and r.species_confidence is None and r.error == "classifier: ValueError: bad input"
        assert len(r.crop.data) == r.crop.height * r.crop.width * 3


def test_train_and_evaluate(spark):
    emb = X.logits(spark, SF01).withColumnRenamed("logits", "embedding")
    model, train, val = TR.train_species_classifier(emb, max_iter=50)
    assert train.count() == 400 and val.count() == 100
    metrics, confusion = TR.evaluate(model, val)
    m = metrics.first()
    assert m["samples"] == 100 and 0 <= m["accuracy"] <= 100 and m["batches"] == 7
    assert confusion.agg(F.sum("n")).first()[0] == 100
    # the model learns the training data well beyond chance (10 classes)
    tm, _ = TR.evaluate(model, train)
    assert tm.first()["accuracy"] > 20.0


def test_epoch_log_feeds_best_epochs(spark):
    from sightings.operators import vectors as VE

    # two classes that a plane separates
    rows = [(i, [float(i % 2) + 0.01 * (i % 7), 1.0 - float(i % 2)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    best, log, val = TR.train_epochs(df, [4], epochs=3, steps=10)
    got = log.orderBy("epoch").collect()
    assert [r.epoch for r in got] == [0, 1, 2] and got[0].lr > got[1].lr > got[2].lr > 0
    assert all(0 <= r.val_acc <= 100 and r.train_loss > 0 for r in got)
    saved = [r.epoch for r in VE.best_epochs(log).orderBy("epoch").collect()]
    if saved:
        assert TR.evaluate(best, val)[0].first()["accuracy"] == got[saved[-1]].val_acc


def test_onnx_classifier_path(spark):
    from tests.onnx_model import linear_model

    d = tempfile.mkdtemp(prefix="sightings-onnx-")
    rnd = np.random.default_rng(3)
    size, k = 8, 5
    w = rnd.normal(size=(3 * size * size, k)).astype(np.float32)
    b = rnd.normal(size=k).astype(np.float32)
    path = os.path.join(d, "model.onnx")
    with open(path, "wb") as fh:
        fh.write(linear_model(w, b, size))
    assert INF.onnx_input_size(path) == size
    x = rnd.normal(size=(7, 3 * size * size)).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "vec_id long, tensor array<float>")
    out = INF.predict(df, INF.onnx_factory(path), "onnx8", shape=(3, size, size)).orderBy("vec_id").collect()
    want = x @ w + b
    assert np.allclose(np.array([r["logits"] for r in out]), want, atol=1e-4)


def test_two_stage_with_onnx_classifier(spark):
    from tests.onnx_model import linear_model

    d = tempfile.mkdtemp(prefix="sightings-m8o-")
    for name, data in fixture_images().items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    rnd = np.random.default_rng(5)
    size = 16
    path = os.path.join(d, "cls.onnx")
    with open(path, "wb") as fh:
        fh.write(linear_model(rnd.normal(size=(3 * size * size, 3)).astype(np.float32),
                              np.zeros(3, dtype=np.float32), size))
    frames, _ = FS.read_frames(spark, d)
    frames = frames.withColumn("frame_id", F.xxhash64("path"))
    cm = spark.createDataFrame([(0, "wren"), (1, "jay")], "idx int, class_name string")  # idx 2 -> class_2
    dets, best = INF.two_stage(frames, X.class_dim(spark), _fake_detector, "fake", INF.onnx_factory(path),
                               "onnx16", cm, size=INF.onnx_input_size(path))
    species = {r["species"] for r in dets.collect()}
    assert len(dets.collect()) == 4 and species <= {"wren", "jay", "class_2"}
    assert best.count() == 4


def test_predict_batch_udf_variant_matches(spark):
    tmp = tempfile.mkdtemp(prefix="sightings-pbu-")
    path = _linear(tmp, 64, 5)
    df = X.logits(spark, SF01).select("vec_id", F.col("logits").alias("tensor"))
    a = {r["vec_id"]: r["logits"] for r in INF.predict(df, INF.numpy_linear_factory(path), "lin64").collect()}
    b = {r["vec_id"]: r["logits"] for r in INF.predict_batched(df, INF.numpy_linear_factory(path), (64,), batch_size=16).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


def test_training_script_over_images(spark, tmp_path):
    """Folders to classifier: small classes go, augmentation is reproducible, validation images are held out."""
    import numpy as np

    from sightings.operators import training as TR
    from tests.pngs import png_bytes

    rnd = np.random.default_rng(8)
    for name, tint, n in (("jay", (0, 0, 150), 20), ("robin", (150, 0, 0), 20), ("rare", (0, 150, 0), 2)):
        (tmp_path / name).mkdir()
        for i in range(n):
            rgb = np.clip(rnd.integers(0, 80, (24, 32, 3)) + np.array(tint), 0, 255).astype(np.uint8)
            (tmp_path / name / f"{i}.png").write_bytes(png_bytes(rgb))
    model, index, metrics, confusion = TR.train_from_images(spark, str(tmp_path), epochs=2, seed=3, size=16, grid=4, max_iter=20)
    assert sorted((r.class_name, r.idx) for r in index.collect()) == [("jay", 0), ("robin", 1)]
    row = metrics.first()
    assert row.samples == 8 and row.accuracy == 100.0 and sum(r.n for r in confusion.collect()) == 8
    again, *_ = TR.train_from_images(spark, str(tmp_path), epochs=2, seed=3, size=16, grid=4, max_iter=20)
    assert np.allclose(model.coefficientMatrix.toArray(), again.coefficientMatrix.toArray(), atol=1e-6)
