"""Vector operators on logits: softmax (F12), top-1 (O4/M4 with J2 names), batch metrics (A7),
best epochs (W7) and the cosine learning-rate schedule (F14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..plans.ranges import ranked


def _staged_softmax(df: DataFrame, logits_col: str) -> DataFrame:
    """Softmax in stages (max, exponentials, sum as their own columns) so the optimizer evaluates
    each once per row instead of once per array element."""
    return (
        df.withColumn("_a", F.transform(F.col(logits_col), lambda x: x.cast("double")))
        .withColumn("_m", F.array_max("_a"))
        .withColumn("_e", F.transform("_a", lambda x: F.exp(x - F.col("_m"))))
        .withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x))
    )


def top1(logits: DataFrame, class_map: DataFrame, logits_col: str = "logits") -> DataFrame:
    """M4: softmax -> first arg-max -> class name, or ``class_<idx>`` when the mapping lacks it.

    The class map is one row per class index; AQE broadcasts it after measuring its size.
    """
    p = _staged_softmax(logits, logits_col).withColumn("_p", F.transform("_e", lambda x: x / F.col("_s")))
    p = p.withColumn("top_idx", S.argmax_first("_p")).withColumn("top_prob", F.element_at("_p", F.col("top_idx") + 1))
    cm = class_map.select(F.col("idx").alias("top_idx"), F.col("class_name").alias("_name"))
    out = p.join(cm, on="top_idx", how="left")
    return out.withColumn(
        "species", F.coalesce(F.col("_name"), F.concat(F.lit("class_"), F.col("top_idx").cast("string")))
    ).drop("_a", "_m", "_e", "_s", "_p", "_name")


def with_loss(logits: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    """Prediction and cross-entropy per row: pred = first arg-max, loss = logsumexp - logit[label]."""
    st = _staged_softmax(logits, logits_col)
    return st.withColumn("pred", S.argmax_first(logits_col)).withColumn(
        "loss", F.col("_m") + F.log("_s") - F.element_at("_a", F.col(label_col) + 1)
    ).drop("_a", "_m", "_e", "_s")


def batch_ids(df: DataFrame, order: list[str], batch_size: int = config.BATCH_SIZE) -> DataFrame:
    """Loader batches: consecutive rows in ``order`` (any types) grouped by ``batch_size``, by their global
    position in ranges of the order."""
    r = ranked(df, order, "_pos")
    return r.withColumn("batch_id", F.floor(F.col("_pos") / F.lit(int(batch_size))).cast("long")).drop("_pos")


def classification_metrics(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
                           loss_col: str = "loss", batch_col: str = "batch_id") -> DataFrame:
    """accuracy = 100 * correct / total; loss = unweighted mean of per-batch mean losses (a short
    last batch weighs like a full one). Two hash aggregations."""
    per = pred.groupBy(batch_col).agg(
        F.avg(loss_col).alias("_bl"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col(label_col) == F.col(pred_col), 1).otherwise(0)).alias("_c"),
    )
    return per.agg(
        F.sum("_n").cast("long").alias("samples"),
        F.sum("_c").cast("long").alias("correct"),
        (F.lit(100.0) * F.sum("_c") / F.sum("_n")).alias("accuracy"),
        F.avg("_bl").alias("mean_batch_loss"),
        F.count(F.lit(1)).alias("batches"),
    )


def best_epochs(log: DataFrame, epoch_col: str = "epoch", acc_col: str = "val_acc") -> DataFrame:
    """Epochs saved as best: val accuracy strictly above every earlier one and above 0.0. The
    earlier maximum is the running maximum of the accuracies one epoch before."""
    w = Window.orderBy(epoch_col).rowsBetween(Window.unboundedPreceding, -1)  # one row per epoch of one training
    saved = F.col(acc_col) > F.coalesce(F.max(acc_col).over(w), F.lit(0.0))
    return log.withColumn("_saved", saved & (F.col(acc_col) > F.lit(0.0))).where("_saved").drop("_saved")


def cosine_schedule(df: DataFrame, epoch_col: str = "epoch", lr0: float = config.LEARNING_RATE,
                    t_max: int = config.EPOCHS) -> DataFrame:
    """F14 per row."""
    return df.withColumn("lr", S.cosine_lr(epoch_col, lr0, t_max))
