"""Exact score margins from counts of blocks."""

import numpy as np
import pyarrow as pa
import pytest

from trackgrid.operators import retrieval


@pytest.mark.parametrize("n", [1, 2, 501, 800])
def test_margins(spark, n):
    rng = np.random.default_rng(n)
    unit = lambda k: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(k, 5)))
    q, g = unit(70), unit(n)
    g[: n // 2] = g[0]  # ties
    g[-1] = -q[0]
    frame = lambda v, name: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} long, embedding array<double>")
    got = {r["query_id"]: r["margin"] for r in retrieval.margins(frame(q, "query_id"), frame(g, "vec_id"), block=100).collect()}
    scores = np.round(q @ g.T, 6)
    want = scores.max(axis=1) - np.median(scores, axis=1)
    assert len(got) == 70 and np.allclose([got[i] for i in range(70)], want, atol=1e-12)


def test_margins_of_an_empty_gallery_and_long_vectors(spark):
    one = spark.createDataFrame([(1, [3.0, 4.0])], "query_id long, embedding array<double>")
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert retrieval.margins(one, none).collect() == []
    with pytest.raises(Exception, match="unit length"):
        retrieval.margins(one, one.withColumnRenamed("query_id", "vec_id")).collect()


def test_a_block_of_scores_is_counted_in_a_few_megabytes():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = pa.table({"query_id": pa.array(range(300), pa.int64()), "q": pa.array(v.tolist())})
    g = pa.table({"v": pa.array(v.tolist())})
    for block in (q, q.append_column("low", pa.array([700] * 300)).append_column("high", pa.array([1024] * 300))):
        out = retrieval._counted(block, g)
        assert out.nbytes < 300 * 10_000 and out["best"].to_pylist() == [retrieval.HALF + retrieval.MILLION] * 300
    assert out.num_rows == 300 and retrieval._counted(q, g.slice(0, 0)).num_rows == 0
