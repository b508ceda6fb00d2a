"""Classifier training and evaluation on feature vectors (M5, M6).

The reference fine-tunes a CNN with AdamW and a cosine schedule. Re-aimed for a cluster: an MLlib
multinomial logistic regression (or a small MLP) on feature vectors, with the exact 80/20 split of
O2. Evaluation reports accuracy, the loss of A7 and a confusion matrix. ``train_from_images`` is the whole
training script over labelled image folders, augmentation included.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..sources import files as FS
from . import corpus as CO
from . import images as IM
from . import vectors as VE


def features(df: DataFrame, array_col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def train_species_classifier(df: DataFrame, key_col: str = "vec_id", array_col: str = "embedding",
                             label_col: str = "label", frac: float = config.TRAIN_FRACTION, seed: int = 0,
                             max_iter: int = 100, reg: float = config.WEIGHT_DECAY, hidden: list[int] | None = None):
    """M5: exact split (O2 on the row key), then fit. Returns ``(model, train, val)``."""
    keyed = features(df, array_col).withColumn("path", F.col(key_col).cast("string"))
    train, val = CO.split_exact(keyed, frac, seed)
    if hidden:
        n_in = len(df.select(array_col).first()[0])
        n_out = df.agg(F.max(label_col)).first()[0] + 1
        est = MultilayerPerceptronClassifier(layers=[n_in, *hidden, n_out], maxIter=max_iter, seed=seed,
                                             labelCol=label_col, featuresCol="features")
    else:
        est = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial", labelCol=label_col,
                                 featuresCol="features")
    return est.fit(train), train, val


def train_epochs(df: DataFrame, hidden: list[int], epochs: int = config.EPOCHS, steps: int = 20, lr0: float = 0.5,
                 key_col: str = "vec_id", array_col: str = "embedding", label_col: str = "label",
                 frac: float = config.TRAIN_FRACTION, seed: int = 0):
    """M5 with its epoch log: an MLP trained ``epochs`` times ``steps`` gradient steps, each epoch from the
    weights of the one before and with the step size of the cosine schedule (F14). Returns ``(model of the
    last saved epoch, log, val)``; the log has epoch, lr, train and val loss and accuracy, and is what W7
    reads. A saved epoch is one that W7 would save: the best validation accuracy so far.
    """
    keyed = features(df, array_col).withColumn("path", F.col(key_col).cast("string"))
    train, val = CO.split_exact(keyed, frac, seed)
    layers = [len(df.select(array_col).first()[0]), *hidden, df.agg(F.max(label_col)).first()[0] + 1]
    weights, best, top, rows = None, None, 0.0, []
    for epoch in range(epochs):
        lr = lr0 * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        est = MultilayerPerceptronClassifier(layers=layers, maxIter=steps, solver="gd", stepSize=max(lr, 1e-6), seed=seed,
                                             labelCol=label_col, featuresCol="features")
        if weights is not None:
            est = est.setInitialWeights(weights)
        model = est.fit(train)
        weights = model.weights
        seen = [evaluate(model, part, label_col, key_col=key_col)[0].first() for part in (train, val)]
        rows.append((epoch, lr, *(float(r[c]) for r in seen for c in ("mean_batch_loss", "accuracy"))))
        if rows[-1][-1] > top:
            best, top = model, rows[-1][-1]
    log = df.sparkSession.createDataFrame(rows, "epoch int, lr double, train_loss double, train_acc double, val_loss double, val_acc double")
    return best, log, val


def pooled(df: DataFrame, size: int, grid: int, tensor_col: str = "tensor") -> DataFrame:
    """The mean of each cell of a ``grid`` x ``grid`` net over each channel of a CHW tensor, as ``embedding``."""
    step = size // grid

    @F.pandas_udf("array<double>")
    def pool(t: pd.Series) -> pd.Series:
        x = np.stack(t.to_numpy()).reshape(-1, 3, size, size)[:, :, :step * grid, :step * grid].astype(float)
        return pd.Series(list(x.reshape(-1, 3, grid, step, grid, step).mean(axis=(3, 5)).reshape(len(t), -1)))

    return df.where(F.col(tensor_col).isNotNull()).withColumn("embedding", pool(tensor_col)).drop(tensor_col)


def train_from_images(spark: SparkSession, root: str, epochs: int = config.EPOCHS, seed: int = 0, size: int = config.INPUT_SIZE,
                      grid: int = 8, min_samples: int = config.MIN_SAMPLES, frac: float = config.TRAIN_FRACTION,
                      max_iter: int = 100, reg: float = config.WEIGHT_DECAY):
    """The training script over ``<root>/<class>/<image>``: S2 -> A1 / A2 -> W1 -> J4 -> O2 -> M2 -> M5 -> M6.

    Each training image is augmented anew for every epoch (M2, reproducible by seed, path and epoch), all by one job;
    validation images are resized only. The classifier is fit on the tensors' grid means. Returns ``(model, class
    index, metrics, confusion)``; the index goes to K6."""
    samples = FS.read_labelled_images(spark, root)
    index = CO.class_index(CO.valid_classes(CO.class_counts(samples, FS.list_class_dirs(spark, root)), min_samples))
    train, val = CO.split_exact(CO.sample_index(samples, index), frac, seed)
    # Spark's readers write the scheme of local files in two ways
    same = [F.regexp_replace(c, "^file:/+", "file:/") for c in ("path", "image.origin")]
    images = spark.read.format("image").option("dropInvalid", True).load(root.rstrip("/") + "/*/*.{jpg,png}").select(
        same[1].alias("file"), "image")

    def with_pixels(side: DataFrame) -> DataFrame:
        return side.select(same[0].alias("file"), "path", F.col("class_idx").alias("label")).join(images, "file").drop("file")

    each = with_pixels(train).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs, 1) - 1))))
    made = features(pooled(IM.augment(each, seed, F.col("epoch"), size=size).drop("image"), size, grid))
    still = features(pooled(IM.augment(with_pixels(val), seed, 0, size=size, train=False).drop("image"), size, grid))
    model = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial", labelCol="label", featuresCol="features").fit(
        made.select("label", "features"))
    metrics, confusion = evaluate(model, still, key_col="path")
    return model, index, metrics, confusion


def evaluate(model, val: DataFrame, label_col: str = "label", batch_size: int = config.BATCH_SIZE,
             key_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """M6: (metrics row, confusion matrix). Metrics: A7 accuracy and mean of per-batch mean
    cross-entropy (batches of ``batch_size`` in key order), plus MLlib's weighted F1."""
    pred = model.transform(val)
    prob = pred.withColumn("_p", vector_to_array("probability"))
    prob = prob.withColumn("loss", -F.log(F.element_at("_p", F.col(label_col).cast("int") + 1)))
    prob = prob.withColumn("pred", F.col("prediction").cast("int"))
    batched = VE.batch_ids(prob.select(key_col, label_col, "pred", "loss"), [key_col], batch_size)
    metrics = VE.classification_metrics(batched, label_col=label_col)
    f1 = MulticlassClassificationEvaluator(labelCol=label_col, metricName="f1").evaluate(pred)
    confusion = pred.groupBy(F.col(label_col).alias("label"), F.col("prediction").cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return metrics.withColumn("f1", F.lit(float(f1))), confusion
