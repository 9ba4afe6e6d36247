import numpy as np
import pytest

from feedlake.llm.whitening import op12, rank_one, updated, whiten

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["plain", "zero start", "equal values", "copies", "in one plane"])
def test_rank_one_updates_equal_a_whole_decomposition(kind):
    rng = np.random.default_rng(7)
    d = 24
    values, vectors = (np.zeros(d), np.eye(d)) if kind != "equal values" else (np.full(d, 3.0), np.linalg.qr(rng.normal(size=(d, d)))[0])
    rows = rng.normal(size=(40, d)) * 10.0 ** rng.integers(-3, 4, d)
    if kind == "copies":
        rows[10:] = rows[5]
    if kind == "in one plane":
        rows[:, 3:] = 0
    want = vectors @ np.diag(values) @ vectors.T
    for z in rows:
        values, vectors = rank_one(values, vectors, z)
        want = want + np.outer(z, z)
    scale = np.abs(want).max()
    assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() < 1e-11 * scale and np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-10
    assert np.allclose(values, np.linalg.eigvalsh(want), rtol=1e-9, atol=1e-11 * scale) and (np.diff(values) >= 0).all()
    both = updated(np.zeros(d), np.eye(d), rows)
    assert np.allclose(both[0], np.linalg.eigvalsh(rows.T @ rows), rtol=1e-9, atol=1e-11 * scale)


def brute(vectors, most=32):
    """The covariance whole, in numpy."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    return [sum(int(t) ** 2 for t in r) for r in n * x - s], (z @ q[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


def agrees(got, vectors, most=32):
    deviation, white, share = brute(vectors, most)
    mine = np.array([r.whitened for r in got])
    sign = np.sign((mine * white).sum(axis=0))
    assert [int(r.deviation) for r in got] == deviation and np.abs(mine - sign * white).max() < 1e-6
    assert np.allclose(got[0].explained, share, rtol=1e-7) and got[0].identity_error < 1e-9 and {r.n for r in got} == {len(vectors)}


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, share = brute([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in op12(spark, SF).collect()}
    assert len(got) == len(rows) * white.shape[1]
    sign = [np.sign(sum(got[r.vec_id, c + 1].whitened * white[i, c] for i, r in enumerate(rows))) for c in range(white.shape[1])]
    for i, r in enumerate(rows):
        for c in range(white.shape[1]):
            g = got[r.vec_id, c + 1]
            assert (g.n, g.deviation) == (len(rows), deviation[i]) and abs(g.whitened - sign[c] * white[i, c]) < 1e-6 and abs(g.explained / share[c] - 1) < 1e-7 and g.identity_error < 1e-9


def test_many_partitions_odd_rows_and_a_hot_vector(spark):
    rng = np.random.default_rng(5)
    good = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(200, 6)) * [5, 1, 1, 0.5, 0.2, 0.1]] + [[0.25, -1.5, 3.0, 0.0, 1.0, 2.0]] * 150 + [[1e9, 0, 0, 0, 0, -1e9]]
    bad = [None, [], [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0], [1.0, 2.0], [1e300] * 6]
    ddl = "whitened string, vec_id long, embedding array<double>, n string"
    df = spark.createDataFrame([("clash", i if i % 9 else None, [float(x) for x in v], "n") for i, v in enumerate(good)] + [("clash", 1000 + i, v and [x if x is None else float(x) for x in v], "n") for i, v in enumerate(bad)], ddl).repartition(13)
    for block in (16, 1024):
        got = whiten(df, block=block).collect()
        assert len(got) == len(good)
    assert sorted(int(r.deviation) for r in got) == sorted(brute(good)[0]) and got[0].identity_error < 1e-4
    first = spark.createDataFrame([("c", i, v, "n") for i, v in enumerate(good[:350])], ddl).repartition(5)
    agrees(whiten(first, block=32).orderBy("vec_id").collect(), good[:350])
    agrees(whiten(first, most=2).orderBy("vec_id").collect(), good[:350], 2)
    assert whiten(df.limit(0)).count() == 0 and whiten(df.where("embedding IS NULL")).count() == 0
    same = whiten(df.where("get(embedding, 0) = 0.25D")).collect()
    assert len(same) == 150 and all(r.whitened == [] and r.deviation == 0 for r in same)
