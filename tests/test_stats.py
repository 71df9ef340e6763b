import numpy as np
import pytest

from spreadworks.functions import stats


def test_published_critical_values():
    for tau, p in ((-3.90, 0.01), (-3.34, 0.05), (-3.04, 0.10)):
        assert stats.unit_root_p(tau, 2) == pytest.approx(p, abs=0.002)
    assert stats.unit_root_p(-2.86, 1) == pytest.approx(0.05, abs=0.002)
    assert stats.unit_root_p(9, 1) == 1 and stats.unit_root_p(-99, 2) == 0


def test_student_t():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0)


def walks(seed, n=500):
    g = np.random.default_rng(seed)
    x = np.cumsum(g.standard_normal(n)) + 100
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.7 * e[i - 1] + g.standard_normal()
    return x, 1.5 * x + e, np.cumsum(g.standard_normal(n))


def test_cointegrated_pair_is_found():
    x, y, other = walks(3)
    assert stats.engle_granger(y, x)[1] < 0.01 and stats.johansen(y, x)[3]
    assert stats.johansen(y, x)[2] == pytest.approx(1.5, abs=0.1)
    assert stats.adf(y - 1.5 * x)[1] < 0.01 and stats.kpss(y - 1.5 * x)[1] > 0.05


def test_independent_walks_mostly_pass_as_unrelated():
    low = sum(stats.engle_granger(walks(s)[0], walks(s)[2])[1] < 0.05 for s in range(40))
    assert low <= 8


def test_size_of_the_test_under_the_null():
    g = np.random.default_rng(1)
    hits = sum(stats.engle_granger(np.cumsum(g.standard_normal(200)), np.cumsum(g.standard_normal(200)), 0)[1] < 0.1 for _ in range(300))
    assert 15 <= hits <= 48


def test_kalman_follows_the_hedge():
    x, y, _ = walks(5)
    alpha, beta = stats.kalman(y, x)
    assert beta[-1] + alpha[-1] / x[-1] == pytest.approx(1.5, abs=0.1)
