"""Language identification by nearest centroids (operator 4).

A text becomes a vector of hashed character 1- to 3-grams: letters lower-cased, all else one
separator, counts damped (log), weighted by inverse document frequency and scaled to length one.
Document frequencies count all training texts. Each language gets up to ``CENTROIDS`` centroids by
spherical k-means over a sample of its training texts, ``FIT_ROWS`` a language as a rule (drawn by
hash, the bound of the fit). A text goes to the language of the centroid with the largest cosine.
Distance decides on rejection: a text further from its centroid than nearly all of the centroid's own
sample is marked ``rejected``; it still carries its nearest language, and a caller may drop it.

Rules for odd rows: null texts and texts without a letter are ``und`` with score 0; rows with a null
lang or doc_id teach nothing; without training rows every text is ``und``; repeated rows each get a
row; an empty table gives an empty result. lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import add_columns, held_out, unit_hash

DIMS = 1 << 13
CENTROIDS = 4
FIT_ROWS = 1500
_CHUNK = 1 << 20
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter below 2^16, 0 for all else."""
    out = np.zeros(1 << 16, np.uint32)
    for cp in range(1 << 16):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed grams of a whole text; None without a letter."""
    table, total = _letters(), np.zeros(DIMS)
    last = np.zeros(2, np.uint32)
    shift = np.uint32(32 - 13)
    seen = False
    for at in range(0, len(text or ""), _CHUNK):
        cp = np.frombuffer(text[at:at + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where(cp < 1 << 16, table[np.minimum(cp, (1 << 16) - 1)], 0)
        high = np.flatnonzero(cp >= 1 << 16)
        if len(high):
            c[high] = [x if chr(x).isalpha() else 0 for x in cp[high].tolist()]
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        keep[0] |= last[-1] != 0
        c = np.concatenate([last, c[keep]])
        if len(c) == 2:
            continue
        seen |= bool((c[2:] != 0).any())
        one, two = c[2:] * _MIX[0], c[1:-1] * _MIX[1]
        h = np.concatenate([(one ^ np.uint32(0x5BD1E995)) * _MIX[2] >> shift, (one + two) * _MIX[2] >> shift,
                            (one + two + c[:-2] * _MIX[2] + np.uint32(77)) * _MIX[2] >> shift])
        total += np.bincount(h, minlength=DIMS)
        last = c[-2:]
    return total if seen else None


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, weights) of the normalised vector."""
    at = np.flatnonzero(counts)
    w = np.log1p(counts[at]) * idf[at]
    return at, w / max(np.linalg.norm(w), 1e-12)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each dimension occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b["text"].to_pylist():
                counts = gram_counts(t)
                if counts is not None:
                    df += counts > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["dim", "n"])

    rows = train.select("text").mapInArrow(run, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(DIMS), 0
    for r in rows:  # at most DIMS + 1 rows
        if r.dim < 0:
            n = r.n
        else:
            out[r.dim] = r.n
    return out, n


def _k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts from far-apart rows, so that equal inputs give equal centroids."""
    centre = [x.mean(axis=0)]
    near = x @ centre[0]
    centre = [x[np.argmax(near)]]
    near = x @ centre[0]
    while len(centre) < min(k, len(x)):
        pick = x[np.argmin(near)]
        centre.append(pick)
        near = np.maximum(near, x @ pick)
    c = np.stack(centre)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> dict | None:
    """Learn from the texts and langs of docs (doc_id, text, lang); None if there is nothing to learn."""
    train = docs.filter("lang is not null and text is not null and doc_id is not null")
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    share = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, fit_rows / c))])
    sample = train.filter(unit_hash("doc_id", "text", seed=4) < share[F.col("lang")])

    def vectors(b: pa.RecordBatch) -> list:
        found = [(lambda c: None if c is None else _vector(c, idf))(gram_counts(t)) for t in b["text"].to_pylist()]
        return [pa.array([None if f is None else f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                pa.array([None if f is None else f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))]

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), DIMS), np.float32)
        for i, (at, w) in enumerate(zip(pdf["at"], pdf["w"])):
            x[i, np.asarray(at, dtype=np.int64)] = w
        x = x[np.lexsort(x[:, :64].T)]
        c = _k_means(x, centroids)
        sims = x @ c.T
        own = np.argmax(sims, axis=1)
        best = sims.max(axis=1)
        limit = [float(np.quantile(best[own == j], 0.01)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": list(c.astype(np.float32)), "floor": limit})

    made = (add_columns(sample.select("lang", "text"), vectors, "at array<int>, w array<float>", ["lang"]).filter("at is not null")
            .groupBy("lang").applyInPandas(cluster, "lang string, centre array<float>, floor double").collect())
    if not made:
        return None
    made.sort(key=lambda r: (r.lang, r.floor, list(r.centre[:64])))
    return {"idf": idf, "lang": [r.lang for r in made], "centre": np.array([r.centre for r in made], np.float32),
            "floor": np.array([r.floor for r in made])}


def identify(texts: list, model: dict) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    out = []
    for t in texts:
        counts = gram_counts(t)
        if counts is None:
            out.append(("und", 0.0, True))
            continue
        at, w = _vector(counts, model["idf"])
        sims = model["centre"][:, at] @ w.astype(np.float32)
        best = int(np.argmax(sims))
        out.append((model["lang"][best], float(np.clip(sims[best], 0, 1)), bool(sims[best] < 0.5 * model["floor"][best])))
    return out


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from rows that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", held_out(5, 0).alias("held_out"))
    model = fit(rows.filter("not held_out"))
    known = rows.select("doc_id", "held_out", "text")
    if model is None:
        return known.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(b: pa.RecordBatch) -> list:
        found = identify(b["text"].to_pylist(), shared.value)
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]

    return add_columns(known, judge, "lang_pred string, score double, rejected boolean", ["doc_id", "held_out"])
