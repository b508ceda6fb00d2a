import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightings.llm import quality as q
from tests.llm.util import DOC_SCHEMA, by_id, docs


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def corpus(n=700, seed=1):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(5, 120)))]
        good = k % 5 != 0
        text = " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)
        rows.append((k, text, "en", f"site{k % 3 if good else 9}" if rng.random() < 0.8 else "mixed"))
        if k % 2:
            labels.append((k, int(good), 0))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(9000, None, None, None), (9001, "", "en", "s"), (9002, "word " * 80000, "en", "s"), (None, rows[1][1], "en", "s"), (3, rows[3][1], "en", "s")]
    got = q.op6(docs(spark, rows + odd).withColumn("predicted", F.lit("clash")), label_table(spark, labels + [(None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0)])).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    pred = {r.doc_id: r.predicted for r in got}
    assert np.mean([pred[k] == int(k % 5 != 0) for k in range(700) if held(k)]) > 0.97


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    n = 3000
    y = rng.integers(0, 2, n).astype(float)
    a = y[:, None] * 2.5 + rng.normal(size=(n, 2))
    b = y[:, None] * 2.0 + rng.normal(size=(n, 2))
    labelled, free = [a[:200], b[:200]], [a[200:], b[200:]]

    def pool(models, number, up, down):
        says, out = q.sure(models, free), []
        for v in (0, 1):
            at = np.concatenate([np.flatnonzero(says[:, v] == 1)[:int(up)], np.flatnonzero(says[:, v] == -1)[:int(down)]])
            out.append(([x[at] for x in free], (says[at, v] == 1).astype(float)))
        return out

    alone = q.combine(q.co_train(labelled, y[:200], None), [a, b])
    taught = q.combine(q.co_train(labelled, y[:200], pool), [a, b])
    rest = slice(200, None)
    assert ((taught >= .5) == y)[rest].mean() > 0.94 and ((taught >= .5) == y)[rest].mean() >= ((alone >= .5) == y)[rest].mean() - 0.01


def test_partitions_and_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(250)
    base = by_id(q.op6(docs(spark, rows), label_table(spark, labels)))
    again = by_id(q.op6(docs(spark, rows, 5), label_table(spark, [(k, 1 - g if held(k) else g, t) for k, g, t in labels])))
    assert {k: v["score"] for k, v in base.items()} == pytest.approx({k: v["score"] for k, v in again.items()}, abs=1e-6)


def test_empty_tables(spark):
    rows, labels = corpus(20)
    assert q.op6(spark.createDataFrame([], DOC_SCHEMA), label_table(spark, labels)).count() == 0
    assert {r.score for r in q.op6(docs(spark, rows), label_table(spark, [])).collect()} == {0.5}


def test_more_unlabelled_documents_change_little(spark):
    """The labels that are learned from don't thin out as the corpus grows."""
    rows, labels = corpus(300)
    few = by_id(q.op6(docs(spark, rows), label_table(spark, labels)))
    copies = docs(spark, rows).crossJoin(spark.range(1, 41).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + F.col("copy") * 100_000)
    many = by_id(q.op6(docs(spark, rows).unionByName(copies.drop("copy")), label_table(spark, labels)))
    held_ids = [k for k in range(300) if held(k)]
    for got in (few, many):
        good = np.mean([got[k]["score"] for k in held_ids if k % 5])
        bad = np.mean([got[k]["score"] for k in held_ids if k % 5 == 0])
        assert good > 0.9 and bad < 0.2
        assert np.mean([got[k]["predicted"] == int(k % 5 != 0) for k in held_ids]) > 0.95


def test_sure_rows_are_counted_and_drawn_from_all(spark):
    """The pool against the same rows in memory."""
    rows, labels = corpus(400, seed=3)
    feats = q.features(docs(spark, rows)).toPandas().sort_values("doc_id")
    import pyarrow as pa
    views = q._views(pa.Table.from_pandas(feats, preserve_index=False))
    y = np.array([float(k % 5 != 0) for k in feats["doc_id"]])
    models = [q.fit_logistic(views[v][:200], y[:200], 1e-2) for v in (0, 1)]
    says = q.sure(models, views)
    got = q.corpus_pool(q.features(docs(spark, rows)))(models, 0, 1e9, 1e9)
    for v in (0, 1):
        picked, marks = got[v]
        want = np.flatnonzero(says[:, v] != 0)
        assert len(marks) == len(want) and np.allclose(picked[0], views[0][want]) and (marks == (says[want, v] == 1)).all()
    some = q.corpus_pool(q.features(docs(spark, rows)))(models, 0, 20.0, 5.0)
    assert 5 <= sum(some[0][1] == 1) <= 45
