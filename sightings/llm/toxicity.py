"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two character models of order 5, one of toxic and one of ordinary text, differ in their top-order
counts only; below that both back off to the same continuation counts, gathered over both classes.
So an expression that one class hardly shows is smoothed by what all labelled text says of it.
Characters are written in 32 symbols: a-z without accents, digits, one separator, and any other letter or code
point above U+FFFF as two symbols by hash (104 pairs), so that words of other scripts and emoji keep apart. So
the model has at most 32^5 cells whatever the corpus: that bounds what the driver collects and what is broadcast. Counts cover every labelled row outside the held-out fold, combined
map-side.

A text's evidence is log P_toxic - log P_ordinary per character: its mean (length-normalised), its
sum over the root of the length, and its sums over short stretches, as one insult hardly moves the
mean of a long text. A logistic calibration maps these to a score. It is fitted on rows whose counts
aren't in the model it sees (fold 1 of 4, at most ``CALIBRATION_ROWS`` of them, drawn by hash); the
final model then counts all folds. Labels, lang, source and doc_id are no inputs of a score.

Rules for odd rows: a null text or one without letters or digits has no evidence and gets the
calibrated score of that, 0 to 1, below the threshold; a doc_id with several label rows counts as
toxic if one of them says so; null labels count as none; without toxic or ordinary training rows all
scores are 0; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import add_columns, filter_rows, held_out, unit_hash

ORDER = 5
_SYMBOL_BITS = 5
_CELLS = 1 << (_SYMBOL_BITS * ORDER)
_CONTEXTS = _CELLS >> _SYMBOL_BITS
DISCOUNT = 0.75
THRESHOLD = 0.7
CALIBRATION_ROWS = 20_000
_CHUNK = 1 << 20  # characters of a text handled at a time
_STRETCH = 24
_OTHER = 28  # the first of four symbols that begin a pair


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point below 2^16; ``_OTHER`` stands for letters that take two."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range((1 << 16) - 1):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[:1].lower()
        if "a" <= base <= "z" and len(base) == 1:
            out[cp] = 1 + ord(base) - ord("a")
        elif ch.isdigit():
            out[cp] = 27
        elif ch.isalpha():
            out[cp] = _OTHER
    return out


def symbols(cp: np.ndarray) -> np.ndarray:
    """The symbols of a run of code points."""
    sym = symbol_table()[np.minimum(cp, (1 << 16) - 1)]
    wide = np.flatnonzero((sym == _OTHER) | (cp >= 1 << 16))
    if len(wide):
        mixed = cp[wide] * np.uint32(2654435761)
        sym[wide] = _OTHER + (mixed >> np.uint32(30)).astype(np.uint8)
        sym = np.insert(sym, wide + 1, (1 + (mixed >> np.uint32(20)) % np.uint32(26)).astype(np.uint8))
    return sym


def gram_chunks(text: str | None, chunk: int = _CHUNK) -> Iterator[np.ndarray]:
    """The text's 5-grams as cell numbers, one per symbol; runs of separators count once."""
    last = np.zeros(ORDER - 1, np.int32)
    for at in range(0, len(text or ""), chunk):
        cp = np.frombuffer(text[at:at + chunk].encode("utf-32-le", "surrogatepass"), "<u4")
        sym = symbols(cp)
        keep = sym != 0
        keep[1:] |= sym[:-1] != 0
        keep[0] |= bool(last[-1])
        sym = sym[keep]
        if not len(sym):
            continue
        padded = np.concatenate([last, sym.astype(np.int32)])
        g = padded[:len(sym)].copy()
        for k in range(1, ORDER):
            g = (g << _SYMBOL_BITS) | padded[k:k + len(sym)]
        last = padded[-(ORDER - 1):]
        yield g


def gram_counts(train: DataFrame) -> DataFrame:
    """(code, ordinary/toxic counts of fold 0 and fold 1) from rows (text, toxic, fold)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        total = {"k": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}

        def fold_in() -> None:
            if held:
                k, n = np.unique(np.concatenate(held), return_counts=True)
                both, at = np.unique(np.concatenate([total["k"], k]), return_inverse=True)
                total["k"], total["n"] = both, np.bincount(at, np.concatenate([total["n"], n])).astype(np.int64)
                held.clear()

        size = 0
        for b in batches:
            for text, toxic, fold in zip(b["text"], b["toxic"], b["fold"]):
                for g in gram_chunks(text):
                    held.append(g.astype(np.int64) * 4 + (2 * int(fold) + int(toxic)))
                    size += len(g)
                    if size > 1 << 22:
                        fold_in()
                        size = 0
        fold_in()
        for at in range(0, len(total["k"]), 1 << 16):
            k = total["k"][at:at + (1 << 16)]
            yield pd.DataFrame({"code": (k >> 2).astype(np.int32), "kind": (k & 3).astype(np.int32), "n": total["n"][at:at + (1 << 16)]})

    rows = train.select("text", "toxic", "fold").mapInPandas(run, "code int, kind int, n bigint")
    return rows.groupBy("code").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])


def kneser_ney(codes: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> tuple:
    """(name, codes, their log-likelihood ratios, the ratio of an unseen gram by context)."""
    seen = (ordinary + toxic) > 0
    codes, ordinary, toxic = codes[seen], ordinary[seen].astype(float), toxic[seen].astype(float)
    # continuation counts of the lower orders: in how many contexts a gram was seen, over both classes
    cont, grams = {}, codes
    for k in range(ORDER - 1, 0, -1):
        cont[k] = np.bincount(grams & ((1 << (_SYMBOL_BITS * k)) - 1), minlength=1 << (_SYMBOL_BITS * k)).astype(float)
        grams = np.flatnonzero(cont[k])
    symbols = 1 << _SYMBOL_BITS
    shared = np.full(1, 1.0 / symbols)
    for k in range(1, ORDER):
        c = cont[k].reshape(-1, symbols)
        lower = np.tile(shared, symbols).reshape(-1, symbols) if k > 1 else np.full((1, symbols), shared[0])
        den, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        shared = np.where(den > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(den, 1), lower).ravel()
    context, below = codes >> _SYMBOL_BITS, shared[codes & (_CONTEXTS - 1)]
    logs, weights = [], []
    for c in (ordinary, toxic):
        n = np.bincount(context, c, _CONTEXTS)
        kinds = np.bincount(context, c > 0, _CONTEXTS)
        weight = np.where(n > 0, DISCOUNT * kinds / np.maximum(n, 1), 1.0)
        logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(n[context], 1) + weight[context] * below))
        weights.append(np.log(weight))
    return uuid.uuid4().hex, codes.astype(np.int32), (logs[1] - logs[0]).astype(np.float32), (weights[1] - weights[0]).astype(np.float32)


def dense(model: tuple) -> np.ndarray:
    _, codes, ratios, unseen = model
    out = np.repeat(unseen.astype(np.float16), 1 << _SYMBOL_BITS)
    out[codes] = ratios
    return out


FEATURES = 5


def evidence(text: str | None, ratios: np.ndarray) -> list[float]:
    """Length-normalised ratio, its sum over the root of the length, the strongest stretch, the mean
    of the three strongest blocks, and the log number of strong blocks."""
    n, total, strongest, blocks = 0, 0.0, 0.0, []
    for g in gram_chunks(text):
        x = ratios[g].astype(np.float32)
        run = np.cumsum(x, dtype=np.float64)
        total += float(run[-1])
        n += len(x)
        width = min(_STRETCH, len(x))
        ends = run[width - 1:]
        strongest = max(strongest, float((ends - np.concatenate([[0.0], run[:len(ends) - 1]])).max()))
        blocks.append(np.add.reduceat(x, np.arange(0, len(x), _STRETCH // 2)))
    if not n:
        return [0.0] * FEATURES
    b = np.concatenate(blocks)
    top = np.partition(b, -3)[-3:] if len(b) > 3 else b
    return [total / n, total / n ** 0.5, strongest, float(np.maximum(top, 0).sum()) / 3, float(np.log1p((b > 5).sum()))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) by Newton steps on standardised features."""
    order = np.lexsort(np.column_stack([x, y]).T)  # the same rows give the same sums
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w)),
                               z.T @ (y - p) - ridge * len(x) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


_LOADED: dict[str, np.ndarray] = {}


def _ratios_of(shared) -> np.ndarray:
    """The broadcast model as a dense table, built once in each Python worker."""
    key = shared.value[0]
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = dense(shared.value)
    return _LOADED[key]


def _collected(counts: DataFrame):
    """(codes, four count columns) on the driver: at most 32^5 cells."""
    t = counts.toArrow()
    codes = np.asarray(t["code"].to_numpy(), dtype=np.int64)
    order = np.argsort(codes)
    return codes[order], [np.asarray(t[f"n{k}"].to_numpy(), dtype=np.int64)[order] for k in range(4)]


def scorer(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS):
    """Train on the labelled rows of ``docs``; returns f(texts) -> scores, to be run inside tasks."""
    spark = docs.sparkSession
    marks = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    train = plain.filter(~held_out(3, 1) & F.col("doc_id").isNotNull()).join(marks.hint("shuffle_hash"), "doc_id").withColumn(
        "fold", (unit_hash("doc_id", seed=9) < 0.25).cast("int"))
    codes, n = _collected(gram_counts(train))
    if not (n[0] + n[2]).sum() or not (n[1] + n[3]).sum():
        return lambda texts: np.zeros(len(texts))

    # calibration: fold 1 under the model of fold 0
    partial = spark.sparkContext.broadcast(kneser_ney(codes, n[0], n[1]))
    second = ~held_out(3, 1) & (unit_hash("doc_id", seed=9) < 0.25)
    share = calibration_rows / max(marks.filter(second).count(), 1)
    drawn = second & (unit_hash("doc_id", seed=10) < share)
    cal = plain.filter(drawn).join(marks.filter(drawn).hint("shuffle_hash"), "doc_id")
    names = [f"f{i}" for i in range(FEATURES)]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = np.array([evidence(t, _ratios_of(partial)) for t in b["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame(f, columns=names).assign(toxic=b["toxic"].to_numpy())

    got = cal.select("text", "toxic").mapInPandas(features, ", ".join(f"{c} double" for c in names) + ", toxic int").toPandas()
    x, y = got[names].to_numpy(), got["toxic"].to_numpy(dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        mean, scale, w = fit_logistic(x, y)
    else:  # too few rows to calibrate: a stretch of strong evidence decides
        mean, scale, w = np.zeros(FEATURES), np.ones(FEATURES), np.array([0.0, 0.0, 1.0, 0.0, 0.0, -_STRETCH / 2])
    final = spark.sparkContext.broadcast(kneser_ney(codes, n[0] + n[2], n[1] + n[3]))

    def scores(texts) -> np.ndarray:
        f = np.array([evidence(t, _ratios_of(final)) for t in texts]).reshape(-1, FEATURES)
        s = 1 / (1 + np.exp(-np.clip((f - mean) / scale @ w[:-1] + w[-1], -30, 30)))
        blank = (f == 0).all(axis=1)
        s[blank] = np.minimum(s[blank], 0.5)
        return s

    return scores


def op9(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scores = scorer(docs, labels)

    def judge(b: pa.RecordBatch) -> list:
        s = scores(b["text"].to_pylist())
        return [s, (s >= threshold).astype(np.int32)]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(3, 1).alias("held_out"))
    return add_columns(rows, judge, "score double, predicted int", ["doc_id", "held_out"])


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't predicted toxic, as they are."""
    scores = scorer(docs, labels)
    return filter_rows(docs, lambda b: scores(b["text"].to_pylist()) < threshold)
