import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sightings.llm import suffix_dedup as sx
from tests.llm.util import DOC_SCHEMA, docs


def brute(rows, width=50):
    """{row number: removed byte flags}"""
    first = {}
    raws = [(t or "").encode() for _, t in rows]
    key = [d if d is not None else float("inf") for d, _ in rows]
    for d, raw in zip(key, raws):
        for i in range(len(raw) - width + 1):
            s = raw[i:i + width]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, raw in zip(key, raws):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if first[raw[i:i + width]] < d:
                gone[i:i + width] = True
        out.append(gone)
    return raws, out


def expected(rows):
    raws, gone = brute(rows)
    return sorted((str(d), len(r), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1).sum()),
                   hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~g])).hexdigest()) for (d, _), r, g in zip(rows, raws, gone))


def corpus(seed, n=60, letters="abcé \n"):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list(letters), k))
    passages = [text(int(k)) for k in rng.integers(30, 160, 8)]
    rows = []
    for k in range(n):
        parts = [text(int(rng.integers(0, 120)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [passages[int(rng.integers(0, 8))], text(int(rng.integers(0, 60)))]
        rows.append((int(rng.integers(0, 40)), "".join(parts)))
    return rows


def test_index_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        parts = [bytes(rng.integers(97, 99, int(rng.integers(1, 40))).astype(np.uint8)) for _ in range(12)]
        doc = rng.integers(0, 6, 12)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        got = sx.repeated_strings(raw, np.array([len(p) for p in parts]), doc, width=6)
        want = []
        for p, d in zip(parts, doc):
            for i in range(len(p)):
                s = p[i:i + 6]
                want.append(len(s) == 6 and any(s in q and e < d for q, e in zip(parts, doc)))
        assert got.tolist() == want


def test_matching_statistics_stream_from_run_ends():
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.integers(2, 4, 300), [0]])
    length, above = sx.matching_statistics(t, 1000)
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    for up, i in zip(order, order[1:]):
        k = 0
        while i + k < len(t) and up + k < len(t) and t[i + k] == t[up + k]:
            k += 1
        assert (length[i], above[i]) == (k, up)


def test_equals_brute_force_on_documents(spark):
    rows = corpus(1) + [(None, None), (3, ""), (7, "é" * 200), (1, "é" * 130), (39, "x" * 49), (38, "x" * 50), (37, "x" * 51)]
    rows += [(100, rows[5][1]), (101, rows[5][1]), (None, rows[6][1] + "tail"), (5, rows[5][1])]
    d = docs(spark, rows).withColumn("n_bytes", F.lit(3))
    for chunk in (1 << 22, 400):
        def finish(table, r):
            r["doc_id"] = table["doc_id"].to_pandas().astype("Int64")
            r["sha"] = [hashlib.sha256(k).hexdigest() for k in r["kept"]]
            return r[["doc_id", "n_bytes", "n_removed", "n_spans", "sha"]]
        got = sx.dedup(d, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, sha string", finish, chunk_bytes=chunk)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got.collect()) == expected(rows)


def test_contract_and_stage(spark):
    long = "".join(f"word{k} " for k in range(60))
    rows = [(2, long + "zwei"), (1, "eins " + long), (3, "short"), (4, None)]
    got = sx.op2(docs(spark, rows))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == expected(rows)
    kept = {r.doc_id: r for r in sx.strip_repeats(docs(spark, rows).withColumn("chunk", F.lit("own"))).collect()}
    assert kept[2].text == "zwei" and kept[2].n_chars == 4 and kept[1].text == "eins " + long
    assert kept[4].text is None and kept[4].n_chars is None and kept[3].chunk == "own"


def phrases(n=300):
    rng = np.random.default_rng(8)
    text = lambda k: "".join(rng.choice(list("abcdefghij"), k))
    phrase = text(49)
    rows = [(k % 250, text(60) + phrase + text(60) + phrase[:30] + text(60)) for k in range(n)]
    return rows + [(700 + k, rows[k][1][20:130] + text(40)) for k in range(20)] + [(None, rows[3][1]), (2, rows[9][1]), (800, phrase + "é")]


def test_hot_hashes_equal_brute_force(spark):
    def finish(table, r):
        r["doc_id"] = table["doc_id"].to_pandas().astype("Int64")
        r["sha"] = [hashlib.sha256(k).hexdigest() for k in r["kept"]]
        return r[["doc_id", "n_bytes", "n_removed", "n_spans", "sha"]]
    for rows, hot in ((phrases(), 40), (corpus(1), 1), (corpus(2), 5)):
        got = sx.dedup(docs(spark, rows), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, sha string", finish, chunk_bytes=3000, hot=hot)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got.collect()) == expected(rows)


def test_a_phrase_in_many_contexts_is_not_gathered():
    import zstandard

    blobs = []
    for k in range(0, 300, 50):
        rows = phrases()[k:k + 50]
        t = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [x for _, x in rows]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        blobs.append((k, zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes())))
    chunks = pa.RecordBatch.from_pydict({"chunk": [k for k, _ in blobs], "blob": [b for _, b in blobs]})
    hashes = pd.concat([b.to_pandas() for b in sx._pack_hashes(iter([chunks]), 6, 50)])
    masks = pd.concat([sx._repeated_hashes(g, 40) for _, g in hashes.groupby("bucket")])
    assert masks["hot"].notna().any()
    frame = chunks.to_pandas()
    found = pd.concat([sx._segments(frame[frame.chunk == k], masks[masks.chunk == k], 6, 6, 50) for k in frame.chunk])
    segments = found[found.bucket < 64].groupby("bucket").n.sum()
    strings = found[found.bucket >= 64].groupby("bucket").n.sum()
    assert segments.max() <= 80 and strings.max() < 0.1 * strings.sum()


def test_empty_table(spark):
    e = spark.createDataFrame([], DOC_SCHEMA)
    assert sx.op2(e).count() == 0 and sx.strip_repeats(e).count() == 0
