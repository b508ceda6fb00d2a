import zlib

import numpy as np
import pytest

from sightings.llm import toxicity as tx
from tests.llm.util import DOC_SCHEMA, by_id, docs

BAD = ["idiot", "stupid", "moron", "scum"]


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def corpus(n=900, seed=1):
    rng = np.random.default_rng(seed)
    syl = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(syl, int(rng.integers(1, 4))))
    rows, labels = [], []
    for k in range(n):
        w = [word() for _ in range(int(rng.integers(5, 200)))]
        toxic = k % 8 == 0
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(BAD)))
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, "  \n"), (None, "you stupid idiot, you moron scum"), (5003, "there " * 50000), (3, rows[3][1])]
    marks = labels + [(None, 1, 1), (77777, 1, 1), (5, None, None), (8, 0, 0), (8, 1, 1)]
    got = tx.op9(docs(spark, rows + odd), label_table(spark, marks)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and held(r.doc_id))
    pred = {r.doc_id: r.predicted for r in got}
    test = [k for k, _, _ in labels if held(k)]
    wrong = sum(pred[k] != int(k % 8 == 0) for k in test)
    assert wrong <= 0.02 * len(test)
    assert pred[None] == 1 and pred[5000] == pred[5001] == pred[5002] == 0


def test_scores_do_not_depend_on_labels_of_the_row_or_on_partitions(spark):
    rows, labels = corpus(300)
    base = by_id(tx.op9(docs(spark, rows), label_table(spark, labels)))
    flipped = [(k, q, 1 - t if held(k) else t) for k, q, t in labels]
    again = by_id(tx.op9(docs(spark, [(k, t, "xx", "other") for k, t in rows], 5), label_table(spark, flipped)))
    assert {k: v["score"] for k, v in base.items()} == pytest.approx({k: v["score"] for k, v in again.items()}, abs=1e-9)


def test_empty_tables(spark):
    rows, labels = corpus(20)
    assert tx.op9(spark.createDataFrame([], DOC_SCHEMA), label_table(spark, labels)).count() == 0
    assert {r.score for r in tx.op9(docs(spark, rows), label_table(spark, [])).collect()} == {0.0}


def test_probabilities_of_a_context_sum_to_one():
    g = np.concatenate(list(tx.gram_chunks("the cat and the hat and the bat that sat")))
    codes, n = np.unique(g, return_counts=True)
    symbols = 1 << 5
    context = int(codes[3]) >> 5
    grams = (context << 5) + np.arange(symbols)
    # the ratio of two models of which one has the counts and one has none is P / P_shared
    name, c, ratio, unseen = tx.kneser_ney(codes.astype(np.int64), np.zeros(len(codes), np.int64), n)
    table = np.repeat(unseen, symbols)
    table[c] = ratio
    cont = {k: None for k in range(1, 5)}
    kinds = codes
    for k in range(4, 0, -1):
        cont[k] = np.bincount(kinds & ((1 << 5 * k) - 1), minlength=1 << 5 * k)
        kinds = np.flatnonzero(cont[k])

    def shared(gram, k):
        if k == 0:
            return 1 / symbols
        own = cont[k].reshape(-1, symbols)[(gram & ((1 << 5 * k) - 1)) >> 5]
        low = shared(gram, k - 1)
        return low if not own.sum() else (max(own[gram & 31] - 0.75, 0) + 0.75 * (own > 0).sum() * low) / own.sum()

    assert sum(np.exp(table[x]) * shared(int(x), 4) for x in grams) == pytest.approx(1, abs=1e-5)


def test_chunks_join_seamlessly():
    text = "Hällo,  wörld!! " * 40 + "漢字 end"
    whole = np.concatenate(list(tx.gram_chunks(text)))
    for size in (1, 7, 100):
        assert np.array_equal(whole, np.concatenate(list(tx.gram_chunks(text, size))))


def plain_model(texts):
    """Kneser-Ney over dictionaries. texts: (text, toxic); returns the log-likelihood ratio of a 5-gram of symbols."""
    import math
    from collections import Counter, defaultdict

    table = tx.symbol_table()

    def grams(text):
        out = [0]
        for ch in text or "":
            s = int(table[min(ord(ch), (1 << 16) - 1)])
            if s == 28 or ord(ch) > 0xFFFF:
                mixed = ord(ch) * 2654435761 & 0xFFFFFFFF
                out += [28 + (mixed >> 30), 1 + (mixed >> 20) % 26]
            elif s or out[-1]:
                out.append(s)
        out = [0, 0, 0, *out]
        return [tuple(out[i - 4:i + 1]) for i in range(4, len(out))]

    counts = [Counter(g for t, k in texts if k == kind for g in grams(t)) for kind in (0, 1)]
    cont, level = {}, set(counts[0]) | set(counts[1])
    for k in range(4, 0, -1):
        cont[k] = Counter(g[1:] for g in level)
        level = set(cont[k])

    def by_context(c):
        total, kinds = defaultdict(float), defaultdict(int)
        for g, n in c.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return total, kinds

    sums = {k: by_context(cont[k]) for k in cont}
    tops = [by_context(c) for c in counts]

    def shared(g):
        lower = shared(g[1:]) if len(g) > 1 else 1 / 32
        total, kinds = sums[len(g)]
        if not total[g[:-1]]:
            return lower
        return (max(cont[len(g)][g] - tx.DISCOUNT, 0) + tx.DISCOUNT * kinds[g[:-1]] * lower) / total[g[:-1]]

    def ratio(g):
        logs = []
        for c, (total, kinds) in zip(counts, tops):
            n = total[g[:-1]]
            weight = tx.DISCOUNT * kinds[g[:-1]] / n if n else 1.0
            logs.append(math.log(max(c[g] - tx.DISCOUNT, 0) / max(n, 1) + weight * shared(g[1:])))
        return logs[1] - logs[0]

    return grams, ratio


def test_model_equals_dictionaries_on_two_hundred_documents(spark):
    rows, labels = corpus(200, seed=4)
    toxic = {k: t for k, _, t in labels}
    train = [(k, t) for k, t in rows if k % 4]
    df = spark.createDataFrame([(t, toxic[k], 0) for k, t in train], "text string, toxic int, fold int").repartition(3)
    codes, n = tx._collected(tx.gram_counts(df))
    ratios = tx.dense(tx.kneser_ney(codes, n[0], n[1]))
    grams, ratio = plain_model([(t, toxic[k]) for k, t in train])
    for text in [t for k, t in rows if k % 4 == 0] + ["", None, "Ünsinn 42!", "дурак you idiot", "😀😡 日本語"]:
        want = [ratio(g) for g in grams(text)]
        got = tx.evidence(text, ratios)
        if not want:
            assert got == [0.0] * tx.FEATURES
            continue
        assert got[0] == pytest.approx(np.mean(want), abs=2e-3) and got[1] == pytest.approx(sum(want) / len(want) ** 0.5, abs=2e-2 + 2e-3 * len(want) ** 0.5)


def test_other_scripts_keep_apart(spark):
    """Words that folded to the same symbols before, emoji, and a model that learns from them."""
    def cells(t):
        return [g for c in tx.gram_chunks(t) for g in c.tolist()]

    assert cells("дурак") != cells("ичмдт") and cells("😀") != cells("😡") and len(cells("😀😡")) == 4
    assert len({tuple(cells(w)) for w in ("дурак", "ичмдт", "привет", "друг", "слово", "дура", "кадур", "добро")}) == 8
    rng = np.random.default_rng(3)
    plain = ["привет", "друг", "слово", "добро", "мир", "день", "утро", "книга"]
    rows, labels = [], []
    for k in range(500):
        w = [str(rng.choice(plain)) for _ in range(30)]
        if k % 6 == 0:
            w[int(rng.integers(0, 30))] = w[int(rng.integers(0, 30))] = "ичмдт" if k % 12 else "😡"
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 6 == 0)))
    got = by_id(tx.op9(docs(spark, rows), label_table(spark, labels)))
    test = [k for k in range(500) if held(k)]
    assert np.mean([got[k]["predicted"] == int(k % 6 == 0) for k in test]) > 0.97
