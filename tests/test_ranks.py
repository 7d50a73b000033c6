"""Order statistics against NumPy."""

import numpy as np
import pytest

from trackgrid.operators import ranks

RNG = np.random.default_rng(5)
KINDS = {
    "wide": np.concatenate([RNG.normal(size=400) * 10.0 ** RNG.integers(-300, 300, 400), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]]),
    "narrow": 1.0 + RNG.integers(0, 1000, 500) * 2.0**-52,  # one range down to the last digits
    "powers": np.concatenate([2.0 ** np.arange(-60, 60), np.nextafter(2.0 ** np.arange(-60, 60), 0), -(2.0 ** np.arange(-60, 60))]),
    "ties": RNG.integers(-3, 3, 500).astype(float),
    "one": np.array([7.5]),
    None: RNG.normal(size=50),
}


def test_quantiles(spark):
    """Wide, dense and tied values, null keys; values that are not finite are left out, and keys without others too."""
    rows = [(k, float(x)) for k, v in KINDS.items() for x in v]
    rows += [("one", float("nan")), ("one", None), ("one", float("inf")), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "v", {"q0": 0.0, "q1": 0.31, "q5": 0.5, "q9": 0.95, "q10": 1.0}).collect()}
    assert set(got) == set(KINDS)
    for k, v in KINDS.items():
        assert got[k]["n"] == len(v)
        want = {c: np.sort(v)[[int(np.floor((len(v) - 1) * p)), int(np.ceil((len(v) - 1) * p))]] for c, p in (("q0", 0.0), ("q1", 0.31), ("q5", 0.5), ("q9", 0.95), ("q10", 1.0))}
        for c, (low, high) in want.items():
            assert min(low, high) <= got[k][c] <= max(low, high)
            assert low != high or got[k][c] == low
        assert got[k]["q5"] == pytest.approx(np.median(v), rel=1e-12)
    assert ranks.quantiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0
    assert ranks.quantiles(df, [], "v", {"q": 0.5}).first()["q"] == pytest.approx(np.median(np.concatenate(list(KINDS.values()))))


def test_ranks_of_one_hot_key(spark):
    """A key with all rows: ranks that exist and one that does not."""
    n = 200_000
    df = spark.range(n).selectExpr("1 AS k", "pmod(id * 7919, 200000) / 7D AS v")
    out = ranks.order_statistics(df, ["k"], "v", {"a": lambda n: n - 1, "b": lambda n: n, "c": lambda n: n / 3})
    r = out.first()
    assert (r["n"], r["a"], r["b"], r["c"]) == (n, (n - 1) / 7.0, None, (n // 3) / 7.0)
