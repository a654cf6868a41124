import math

import numpy as np
import pytest

from symloom.llm.ann import op4_nearest_neighbours, scan, search, usable_rows


def brute_force(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in good if i != q)
            out[q] = near[:k]
    return out


def vectors(n, seed=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * r.standard_normal(8)).astype(np.float32).tolist()) for i in range(n)]
    for i in range(0, n, 3):
        rows[i] = (i, rows[0][1])  # a third of all rows is one vector
    odd = [(5000, None), (5100, []), (5200, [0.0] * 8), (5300, [1.0] * 7 + [None]), (5400, [float("nan")] * 8), (5500, [1.0] * 7 + [float("inf")]), (5600, [1.0] * 9), (None, [1.0] * 8)]
    return rows + odd


def test_query(spark, tmp_path):
    rows = vectors(900)
    spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, v string").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_force(rows)
    got = {}
    for r in op4_nearest_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        exact = {i: d for d, i in brute_force(rows, 10_000)[q]}
        assert all(s == pytest.approx(exact[i], rel=1e-12, abs=1e-12) for _, s, i in found)
        hits += len({i for _, _, i in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_scan_is_near_exact():
    r = np.random.default_rng(1)
    x, q = r.standard_normal((4000, 64)), r.standard_normal((20, 64))
    rotation = np.linalg.qr(r.standard_normal((64, 64)))[0]
    found = list(scan(x, np.arange(4000), q, np.arange(9000, 9020), rotation, 10))
    hits = sum(other in np.argsort(((x - q[i - 9000]) ** 2).sum(axis=1))[:10] for i, other, _ in found)
    assert len(found) == 200 and hits >= 196


def test_few_rows_and_none(spark):
    rows = usable_rows(spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 2.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in search(rows, rows.filter("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]
    empty = usable_rows(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert search(empty, empty).collect() == []
