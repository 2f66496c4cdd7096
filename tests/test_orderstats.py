"""Order statistics from counted buckets against a sort."""

import numpy as np
import pytest

from locusloom.operators import ranking
from locusloom.operators.orderstats import Ordered, greatest_gap


def column(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "score double").repartition(3)


@pytest.mark.parametrize("seed", range(2))
def test_places(spark, seed):
    """Few splits and small buckets, so that buckets are cut several times; ties and infinities included."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.exponential(size=3000), 1 + seed)
    x[:200] = 0.5
    x[200:203] = [np.inf, -np.inf, -np.inf]
    s = Ordered(column(spark, [*x, None, float("nan")]), splits=4, small=20)
    order = np.sort(x)
    places = [0, 1, 2, 3, 17, 1500, 2998, 2999, *rng.integers(0, 3000, 20).tolist(), -1, 3000]
    assert s.n == 3000
    assert s.at(places) == {p: order[p] for p in places if 0 <= p < 3000}


def test_edges(spark):
    assert Ordered(column(spark, [])).at([0]) == {}
    one = Ordered(column(spark, [2.0] * 50), splits=8, small=3)
    assert one.n == 50 and one.at([0, 49]) == {0: 2.0, 49: 2.0}
    assert ranking.score_at(column(spark, []), 0.5) is None


@pytest.mark.parametrize("seed", range(2))
def test_greatest_gap(spark, seed):
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.uniform(-0.1, 1.1, 900), 2), np.round(rng.beta(1, 1 + seed / 3, 700), 2)
    ecdf = lambda v, t, side: np.searchsorted(np.sort(v), t, side) / len(v)
    both = np.r_[x, y]
    d, na, nb = greatest_gap(column(spark, x), column(spark, y), splits=16, small=30)
    assert (na, nb) == (900, 700) and d == pytest.approx(np.abs(ecdf(x, both, "right") - ecdf(y, both, "right")).max(), abs=1e-12)
    u = np.clip(x, 0, 1)
    want = max((ecdf(x, x, "right") - u).max(), (u - ecdf(x, x, "left")).max())
    assert greatest_gap(column(spark, x), None, splits=16, small=30)[0] == pytest.approx(want, abs=1e-12)
    assert greatest_gap(column(spark, []), None)[0] is None
