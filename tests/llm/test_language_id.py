import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightings.llm import language_id as li
from tests.llm.util import DOC_SCHEMA, by_id, docs

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein ich ung ge über ß ö".split(),
             "fr": "eau oui é è ê tion ment qu".split()}


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        lang = list(SYLLABLES)[int(rng.choice(3, p=[.6, .25, .15]))]
        word = lambda: "".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4))))  # noqa: E731, B023
        rows.append((k, " ".join(word() for _ in range(int(rng.integers(3, 80)))), lang, f"s{k % 7}"))
    return rows


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(7000, None, "en", "x"), (7001, "", None, None), (7002, "123 !!", "fr", "x"), (None, "eau oui eau qué", None, "x"),
           (7003, "über ich " * 60000, None, None), (7004, "漢字漢字 かな", None, None), (7005, "𐐷𐐷", "en", "x"), (1, rows[1][1], rows[1][2], "s")]
    got = li.op4(docs(spark, rows + odd).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    for k in (7000, 7001, 7002):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[7003].lang_pred == "de" and by[None].lang_pred == "fr" and by[7005].lang_pred in SYLLABLES
    assert by[7004].lang_pred in SYLLABLES and by[7004].rejected
    test = [r for r in rows if held(r[0])]
    assert np.mean([by[r[0]].lang_pred == r[2] for r in test]) > 0.97
    assert np.mean([by[r[0]].rejected for r in test]) < 0.1


def test_held_out_langs_teach_nothing(spark):
    rows = corpus(200)
    base = by_id(li.op4(docs(spark, rows)))
    again = by_id(li.op4(docs(spark, [(k, t, "zz" if held(k) else lang, "other") for k, t, lang, _ in rows], 5)))
    assert {k: v["lang_pred"] for k, v in base.items()} == {k: v["lang_pred"] for k, v in again.items()}
    assert {k: v["score"] for k, v in base.items()} == pytest.approx({k: v["score"] for k, v in again.items()}, abs=1e-5)


def test_chunks_join_seamlessly(monkeypatch):
    text = "Größe, éà  und  " * 30 + "𐐷a"
    whole = li.gram_counts(text)
    monkeypatch.setattr(li, "_CHUNK", 13)
    assert np.array_equal(whole, li.gram_counts(text))


def test_empty_and_unlabelled_tables(spark):
    assert li.op4(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert {r.lang_pred for r in li.op4(docs(spark, [(1, "text", None, "s"), (2, None, "en", "s")])).collect()} == {"und"}


def test_prediction_equals_dictionaries_on_two_hundred_documents(spark):
    """Document frequencies, weights and cosines by plain dictionaries, with the same centroids."""
    import math
    from collections import Counter

    a, b, c = (int(x) for x in li._MIX)
    word = 0xFFFFFFFF

    def grams(text):
        out = [0, 0]
        for ch in text or "":
            low = ch.lower()
            x = (ord(low) if len(low) == 1 else ord(ch)) if ch.isalpha() else 0
            if x or out[-1]:
                out.append(x)
        if not any(out):
            return None
        found = Counter()
        for z, y, x in zip(out, out[1:], out[2:]):
            one, two = x * a & word, y * b & word
            for mixed in (one ^ 0x5BD1E995, one + two, one + two + z * c + 77):
                found[(mixed * c & word) >> 19] += 1
        return found

    rows = corpus(200)
    train = [r for r in rows if not held(r[0])]
    df = Counter(d for r in train for d in (grams(r[1]) or ()))
    n = sum(grams(r[1]) is not None for r in train)
    model = li.fit(docs(spark, train))
    idf = {d: math.log((1 + n) / (1 + df[d])) + 0.1 for d in range(li.DIMS)}
    assert np.allclose(model["idf"], [idf[d] for d in range(li.DIMS)])
    for (lang, score, _), r in zip(li.identify([r[1] for r in rows], model), rows):
        g = grams(r[1])
        w = {d: math.log1p(k) * idf[d] for d, k in g.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        sims = [sum(float(centre[d]) * v for d, v in w.items()) / norm for centre in model["centre"]]
        best = max(range(len(sims)), key=lambda j: sims[j])
        assert lang == model["lang"][best] and score == pytest.approx(sims[best], abs=1e-4)
