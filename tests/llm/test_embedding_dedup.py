import numpy as np

from sightings.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    n = len(rows)
    v = [None if e is None or not len(e) or any(c is None or not np.isfinite(c) for c in e) or not any(e) else np.array(e, np.float64) for _, e in rows]
    v = [None if x is None else x / np.linalg.norm(x) for x in v]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]):
                link[i, j] = v[i] @ v[j] >= threshold - 1e-15
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == comp:
            break
        comp = new
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[comp[i]] = min(k, least.get(comp[i], k))
    return sorted((str(k), int(link[i].sum()), str(least.get(comp[i])), k == least.get(comp[i])) for i, (k, _) in enumerate(rows))


def fixture():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    rows = []
    for k in range(160):
        e = base[k % 40] * rng.uniform(0.5, 3) + rng.normal(size=16) * 0.12
        rows.append((1000 - k, [float(np.float32(c)) for c in e]))
    rows += [(k + 2000, rows[3][1]) for k in range(5)] + [(50, None), (51, []), (52, [0.0] * 16), (53, [None] + [1.0] * 15),
             (54, [float("nan")] * 16), (55, [float("inf")] * 16), (56, [1.0, 0.0]), (57, [2.0, -0.0]), (58, [1e-30, 1e-32]), (56, [1.0, 0.0])]
    return rows


def result(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def test_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(k, e, 0) for k, e in rows], SCHEMA).repartition(3)
    want = brute(rows)
    assert result(ed.op8(df)) == want
    assert result(ed.near_duplicates(df, group_rows=40)) == want


def test_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = ed.quantise(x)
    approx = ed._product(q, q) * s[:, None] * s[None, :]
    assert (np.abs(x @ x.T - approx) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()


def test_tiles_find_every_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 8)).repeat(6, axis=0) + rng.normal(size=(300, 8)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = ed.tile_links(x, None, 0.95, tile=32)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.95)) if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    i, j = ed.tile_links(x[:140], x[140:], 0.95, tile=32)
    assert {(a, b + 140) for a, b in zip(i.tolist(), j.tolist())} == {p for p in want if p[0] < 140 <= p[1]}


def test_empty_table_and_only_unusable_rows(spark):
    assert ed.op8(spark.createDataFrame([], SCHEMA)).count() == 0
    assert result(ed.op8(spark.createDataFrame([(1, None, 0), (1, None, 1)], SCHEMA))) == [("1", 0, "1", True)] * 2
