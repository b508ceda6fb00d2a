"""Labelled corpus and class mapping: class counts (A1), valid classes (A2), dense class index (W1),
sample index (J4), dropped classes (U3), exact-size split (O1/O2), mapping fingerprint (F10), mapping
diff (J5), key-and-shape match (J6/U2) and the mapping document (K6 payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..plans.scan import exact_rank_threshold, ordered_scan
from ..session import written

IMAGE_EXTENSIONS = (".jpg", ".png")  # lower-case only: a glob for *.jpg does not match .JPG


def is_image(path_col: str = "path") -> F.Column:
    p = F.col(path_col)
    return p.endswith(IMAGE_EXTENSIONS[0]) | p.endswith(IMAGE_EXTENSIONS[1])


def class_counts(files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """A1: count of .jpg + .png files per class (U1: one pass over both suffixes).

    ``files(class_name, path)`` is a directory listing; ``classes`` (one column class_name) lists
    class directories, so empty ones count 0. Default: every class seen in ``files``.
    """
    cls = files.select("class_name").distinct() if classes is None else classes.select("class_name").distinct()
    n = files.where(is_image()).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return cls.join(n, on="class_name", how="left").select("class_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def valid_classes(counts: DataFrame, min_samples: int = config.MIN_SAMPLES) -> DataFrame:
    """A2: classes with ``n >= min_samples``."""
    return counts.where(F.col("n") >= F.lit(int(min_samples)))


def dropped_classes(counts: DataFrame, min_samples: int = config.MIN_SAMPLES) -> DataFrame:
    """The complement, with the printed form ``name(n)``."""
    d = counts.where(F.col("n") < F.lit(int(min_samples)))
    return d.withColumn("label", F.format_string("%s(%d)", F.col("class_name"), F.col("n")))


def class_index(valid: DataFrame) -> DataFrame:
    """Classes sorted by name, dense index from 0 (``class_to_idx``; the inverse is the same
    table read the other way). Ranked in blocks of names with the same two first characters."""
    first_two = F.substring("class_name", 1, 2)
    return ordered_scan(valid.select("class_name").distinct(), [], ["class_name"], [first_two], rank_col="idx") \
        .select("class_name", F.col("idx").cast("int").alias("idx"))


def sample_index(files: DataFrame, index: DataFrame) -> DataFrame:
    """Image samples of kept classes with their class index (inner join with the index)."""
    return files.where(is_image()).join(index, on="class_name", how="inner") \
        .select("path", "class_name", F.col("idx").alias("class_idx"))


def shuffle_key(seed: int, path_col: str = "path") -> F.Column:
    """O1: a reproducible permutation key (the reference shuffle is unseeded)."""
    return F.xxhash64(F.lit(int(seed)), F.col(path_col))


def shuffle(samples: DataFrame, seed: int, path_col: str = "path") -> DataFrame:
    """O1: the samples in a reproducible random order (a distributed sort on the seeded hash,
    ties by path)."""
    return samples.orderBy(shuffle_key(seed, path_col), F.col(path_col))


def split_exact(samples: DataFrame, frac: float = config.TRAIN_FRACTION, seed: int = 0,
                path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """O2: train = the first ``int(frac * n)`` samples of the seeded permutation, val = the rest.

    Exact sizes without a global sort. The samples (narrow rows) are written with their hash once; one scan of it
    counts by bucket, one fetches the bucket of the cut, and each side is a filter.
    """
    keyed = written(samples.withColumn("_h", shuffle_key(seed, path_col)), "split")
    cut = exact_rank_threshold(keyed.select("_h", path_col), "_h", path_col, lambda n: int(frac * n))
    if cut is None:
        return keyed.drop("_h"), keyed.limit(0).drop("_h")
    h, p, copies = cut
    before = (F.col("_h") < F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col(path_col) < F.lit(p)))
    if copies:  # the cut falls among equal samples
        at = (F.col("_h") == F.lit(h)) & (F.col(path_col) == F.lit(p))
        nth = F.row_number().over(Window.partitionBy("_h", path_col).orderBy(path_col))
        keyed = keyed.withColumn("_n", F.when(at, nth))
        before = before | (at & (F.col("_n") <= copies))
    return keyed.where(before).drop("_h", "_n"), keyed.where(~before).drop("_h", "_n")


def mapping_fingerprint(index: DataFrame) -> DataFrame:
    """first 12 hex digits of SHA-256 of the key-sorted compact JSON of class_to_idx, with
    non-ASCII escaped. One global aggregate over the class table (one row per class)."""
    entry = F.struct(F.col("class_name"), F.concat(S.json_string_ascii("class_name"), F.lit(":"),
                                                   F.col("idx").cast("string")).alias("kv"))
    agg = index.agg(F.sort_array(F.collect_list(entry)).alias("_e"), F.count(F.lit(1)).alias("n_classes"))
    doc = F.concat(F.lit("{"), F.array_join(F.transform("_e", lambda e: e["kv"]), ","), F.lit("}"))
    return agg.select(F.col("n_classes").cast("long").alias("n_classes"),
                      F.substring(F.sha2(doc, 256), 1, 12).alias("fingerprint"))


def mapping_document(index: DataFrame) -> DataFrame:
    """K6 payload: {"class_to_idx": {...}, "idx_to_class": {...}} as one JSON string (``value``)."""
    agg = index.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_name", "idx")))).alias("c2i"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("string"), "class_name")))).alias("i2c"),
    )
    return agg.select(F.to_json(F.struct(F.col("c2i").alias("class_to_idx"), F.col("i2c").alias("idx_to_class"))).alias("value"))


def mapping_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per class, old and new index and a status: added, removed, reindexed, same.

    Full outer join on the class name with null-safe comparison of indexes.
    """
    o = old.select("class_name", F.col("idx").alias("old_idx"))
    n = new.select("class_name", F.col("idx").alias("new_idx"))
    j = o.join(n, on="class_name", how="full_outer")
    status = (
        F.when(F.col("old_idx").isNull(), "added")
        .when(F.col("new_idx").isNull(), "removed")
        .when(~F.col("old_idx").eqNullSafe(F.col("new_idx")), "reindexed")
        .otherwise("same")
    )
    return j.withColumn("status", status)


def mapping_mismatch(old: DataFrame, new: DataFrame, old_fp: str | None = None) -> DataFrame:
    """J5 flag: mismatch if the class counts differ or the fingerprints differ (a missing old value
    never counts). One row: old_classes, new_classes, old_fp, new_fp, mismatch."""
    fo = mapping_fingerprint(old).select(F.col("n_classes").alias("old_classes"), F.col("fingerprint").alias("old_fp"))
    fn = mapping_fingerprint(new).select(F.col("n_classes").alias("new_classes"), F.col("fingerprint").alias("new_fp"))
    both = fo.unionByName(fn, allowMissingColumns=True).agg(
        F.max("old_classes").alias("old_classes"), F.max("new_classes").alias("new_classes"),
        F.max("old_fp").alias("old_fp"), F.max("new_fp").alias("new_fp"),
    )
    if old_fp is not None:
        both = both.withColumn("old_fp", F.lit(old_fp))
    return both.withColumn(
        "mismatch",
        F.coalesce(F.col("old_classes") != F.col("new_classes"), F.lit(False))
        | F.coalesce(F.col("old_fp") != F.col("new_fp"), F.lit(False)),
    )


def match_by_key_and_shape(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tensors match when name and shape are equal. status: matched (in both), skipped
    (left only, or shape differs) and missing (right name without a matching left)."""
    l_ = left.select("name", "shape").withColumn("_l", F.lit(True))
    r_ = right.select("name", "shape").withColumn("_r", F.lit(True))
    j = l_.join(r_, on=["name", "shape"], how="full_outer")
    status = F.when(F.col("_l") & F.col("_r"), "matched").when(F.col("_l"), "skipped").otherwise("missing")
    return j.select("name", "shape", status.alias("status"))
