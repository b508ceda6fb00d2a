"""Quality by co-training (operator 6).

Two logistic classifiers look at a document from two sides that share no input. One sees the text:
shares of kinds of characters, word and line statistics, and hashed character pairs. The other sees
what the page says of itself: source, lang, and the declared length. Both start on labelled rows;
then, over ``ROUNDS``, each scores all unlabelled documents, and rows it is sure of (above ``SURE``, or as
far below) are labelled by it for the other one to learn from. Each is calibrated on labelled rows it
hasn't learned from, and the calibrated views are combined by a third small logistic fit on those rows.

Every text is read once: its features are written to the shared folder, and all rounds and the final
scores read those. The driver fits on at most about ``LABELLED_ROWS`` labelled rows, drawn by hash from all
that are labelled outside the held-out fold, and in a round each view adds about ``PICK_SHARE`` of their number,
drawn by hash from all documents it is sure of. So what is learned doesn't depend on how many unlabelled
documents there are.

Rules for odd rows: a null text counts as an empty one; null lang, source and n_chars are values of
their own; a doc_id with several label rows counts as good if one says so; null labels count as
none; rows without a doc_id are scored but not learned from; if the sample's labels are all alike or
missing, scores are their mean, or 0.5; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import add_columns, filter_rows, held_out, stage, unit_hash
from sightings.llm.toxicity import fit_logistic

LABELLED_ROWS = 20_000
ROUNDS = 5
PICK_SHARE = 0.1
SURE = 0.9
_PAIRS = 128
_SOURCES, _LANGS = 64, 16
_CHUNK = 1 << 20


def _kinds() -> np.ndarray:
    """Kind of each code point below 2^16: 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 common
    punctuation, 6 other ASCII, 7 other."""
    out = np.full(1 << 16, 7, np.uint8)
    for cp in range(1 << 16):
        ch = chr(cp)
        if ch == "\n":
            out[cp] = 1
        elif ch.isspace():
            out[cp] = 0
        elif ch.isalpha():
            out[cp] = 3 if ch.isupper() else 2
        elif ch.isdigit():
            out[cp] = 4
        elif cp < 128:
            out[cp] = 5 if ch in ".,;:'\"()-" else 6
    return out


_TABLE: list[np.ndarray] = []


def text_view(text: str | None) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_kinds())
    text = text or ""
    kinds, runs, pairs, n = np.zeros(8), 0, np.zeros(_PAIRS), 0
    for at in range(0, len(text), _CHUNK):
        cp = np.frombuffer(text[at:at + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        k = _TABLE[0][np.minimum(cp, (1 << 16) - 1)]
        kinds += np.bincount(k, minlength=8)
        same = cp[1:] == cp[:-1]
        runs += int(same.sum())
        low = np.where(k == 3, cp + np.uint32(32), cp)
        pairs += np.bincount((low[1:] * np.uint32(2654435761) + low[:-1] * np.uint32(2246822519)) >> np.uint32(25), minlength=_PAIRS)
        n += len(cp)
    words = text.split()
    lines = text.split("\n") if text else []
    m, w = max(n, 1), max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    repeats = sum(a == b for a, b in zip(words, words[1:])) / w
    stats = [*(kinds / m), runs / m, np.log1p(n), np.log1p(len(words)), len(set(words)) / w, repeats, lengths.mean(), lengths.std(),
             np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), kinds[3] / max(kinds[2] + kinds[3], 1)]
    return np.concatenate([stats, np.sqrt(pairs / max(pairs.sum(), 1))])


def _bucket(value, n: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh32_intdigest(str(value).encode("utf-8", "surrogatepass")) % (n - 1)


def _predict(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


#: asked for sure rows of each view and kind: (models, round, quota of good, quota of bad) gives for each view the
#: rows it labels, as two feature matrices, and their labels
Pool = Callable[[list, int, float, float], list[tuple[list[np.ndarray], np.ndarray]]]


def sure(models: list, views: list[np.ndarray]) -> np.ndarray:
    """For each row, what each view says: 1 surely good, -1 surely bad, 0 neither."""
    p = np.column_stack([_predict(models[v], views[v]) for v in (0, 1)])
    return (p > SURE).astype(np.int8) - (p < 1 - SURE).astype(np.int8)


def co_train(views: list[np.ndarray], y: np.ndarray, pool: Pool | None, rounds: int = ROUNDS, pick_share: float = PICK_SHARE) -> dict:
    """views: two feature matrices of the labelled rows; y: 1 or 0; pool: where unlabelled rows come from."""
    apart = np.arange(len(y)) % 4 == 3  # for calibration
    base = ~apart
    if len(set(y[base])) < 2 or len(set(y[apart])) < 2:
        return {"constant": float(np.mean(y)) if len(y) else 0.5}
    known = [[(views[v][base], y[base])] for v in (0, 1)]

    def fit() -> list:
        return [fit_logistic(np.concatenate([x for x, _ in known[v]]), np.concatenate([t for _, t in known[v]]), 1e-2) for v in (0, 1)]

    models, good = fit(), float(y[base].mean())
    picks = 2 * pick_share * int(base.sum())
    for r in range(rounds if pool else 0):
        # as many of each kind as the labelled rows have it
        for v, (rows, labels) in enumerate(pool(models, r, max(1.0, picks * good), max(1.0, picks * (1 - good)))):
            if len(labels):
                known[1 - v].append((rows[1 - v], labels))
        models = fit()
    raw = np.column_stack([_logit(_predict(models[v], views[v][apart])) for v in (0, 1)])
    calibrated = [fit_logistic(raw[:, [v]], y[apart], 1e-3) for v in (0, 1)]
    both = np.column_stack([_logit(_predict(calibrated[v], raw[:, [v]])) for v in (0, 1)])
    return {"models": models, "calibrated": calibrated, "combined": fit_logistic(both, y[apart], 1e-3)}


def combine(model: dict, views: list[np.ndarray]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(views[0]), model["constant"])
    raw = [_logit(_predict(model["models"][v], views[v])) for v in (0, 1)]
    both = np.column_stack([_logit(_predict(model["calibrated"][v], raw[v][:, None])) for v in (0, 1)])
    return _predict(model["combined"], both)


_TEXT_DIMS = 8 + 11 + _PAIRS
_FEATURES = "text_view array<float>, source_at int, lang_at int"


def features(docs: DataFrame) -> DataFrame:
    """The features of every document: doc_id, held_out, n_chars, text_view, buckets of source and lang."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("bigint").alias("n_chars"), held_out(3, 1).alias("held_out"))

    def compute(b: pa.RecordBatch) -> list:
        text = [text_view(t.as_py()).astype(np.float32) for t in b["text"]]
        return [pa.array(text, pa.list_(pa.float32())), *(pa.array([_bucket(x, n) for x in b[c].to_pylist()], pa.int32())
                                                          for c, n in (("source", _SOURCES), ("lang", _LANGS)))]

    return add_columns(rows, compute, _FEATURES, ["doc_id", "held_out", "n_chars"])


def _views(b: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    n = b.num_rows
    lists = b["text_view"].combine_chunks() if isinstance(b, pa.Table) else b["text_view"]
    text = lists.flatten().to_numpy().astype(float).reshape(n, _TEXT_DIMS)
    page = np.zeros((n, _SOURCES + _LANGS + 3))
    page[np.arange(n), b["source_at"].to_numpy()] = 1
    page[np.arange(n), _SOURCES + b["lang_at"].to_numpy()] = 1
    size = b["n_chars"].to_pandas()
    page[:, -3] = size.isna()
    page[:, -2] = np.log1p(np.maximum(size.fillna(0).to_numpy(float), 0))
    page[:, -1] = page[:, -2] ** 2
    return [text, page]


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows["doc_id"].to_numpy(), kind="stable")))


def corpus_pool(free: DataFrame) -> Pool:
    """Sure rows out of all of ``free``: counted first, then drawn by hash so that about the quota of each comes."""

    def pool(models: list, number: int, up: float, down: float) -> list[tuple[list[np.ndarray], np.ndarray]]:
        shared = free.sparkSession.sparkContext.broadcast(models)

        def count(b: pa.RecordBatch) -> list:
            says = sure(shared.value, _views(b))
            return [pa.array(says[:, v] == kind) for v in (0, 1) for kind in (1, -1)]

        names = ["up0", "down0", "up1", "down1"]
        flagged = add_columns(free, count, ", ".join(f"{n} boolean" for n in names), ["doc_id"])
        found = flagged.agg(*[F.count_if(n).alias(n) for n in names]).first()
        shares = np.array([[q / max(found[f"{kind}{v}"], 1) for kind, q in (("up", up), ("down", down))] for v in (0, 1)])
        drawn = free.withColumn("draw", unit_hash("doc_id", seed=100 + number)).filter(F.col("draw") < float(shares.max()))

        def chosen(b: pa.RecordBatch) -> np.ndarray:
            says, draw = sure(shared.value, _views(b)), b["draw"].to_numpy()[:, None]
            return (((says == 1) & (draw < shares[:, 0])) | ((says == -1) & (draw < shares[:, 1]))).any(axis=1)

        rows = _in_order(filter_rows(drawn, chosen).toArrow())
        views, draw = _views(rows), rows["draw"].to_numpy()
        out = []
        for v in (0, 1):
            says = sure(models, views)[:, v] if len(draw) else np.zeros(0)
            use = ((says == 1) & (draw < shares[v, 0])) | ((says == -1) & (draw < shares[v, 1]))
            out.append(([x[use] for x in views], (says[use] == 1).astype(float)))
        return out

    return pool


def score(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, score (of being good), predicted."""
    marks = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("id"))
             .agg(F.max(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)).alias("good")))
    # narrow rows of features meet the labels; texts stay where they are
    rows = features(docs)
    rows = stage(rows.join(marks, F.col("doc_id") == F.col("id"), "left").drop("id"), "quality-features")
    seen = rows.filter("not held_out and doc_id is not null")
    known = seen.filter("good is not null")
    share = labelled_rows / max(known.count(), 1)
    sample = _in_order(known.filter(unit_hash("doc_id", seed=6) < share).toArrow())
    model: dict = {"constant": 0.5}
    if sample.num_rows:
        model = co_train(_views(sample), sample["good"].to_numpy(), corpus_pool(seen.filter("good is null").drop("good")), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(b: pa.RecordBatch) -> list:
        s = combine(shared.value, _views(b))
        return [s, (s >= 0.5).astype(np.int32)]

    return add_columns(rows, judge, "score double, predicted int", ["doc_id", "held_out"])


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)
