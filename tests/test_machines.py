import numpy as np
import pytest

from spreadworks.operators.simulate import bounded_orders, latch, rearmed, to_zero

N = float("nan")


def test_latch_enters_leaves_and_stops():
    assert latch(np.array([0, 2.1, 1.0, 0.4, -2.5, -4.5, N, -2.2, N]), 2, 0.5, 4) == [0, -1, -1, 0, 1, 0, 0, 1, 1]


def test_rearmed_waits_and_needs_a_calm_z():
    z = np.array([2.5, 4.2, 3.0, 0.9, 0.8, 2.5, 2.6])
    target, stop = rearmed(z, 2, 0.5, 4, 2, 1.0)
    assert target == [-1, 0, 0, 0, 0, -1, -1] and stop == [False, True] + [False] * 5


def test_rearmed_missing_z_holds():
    assert rearmed(np.array([2.5, N, 0.1]), 2, 0.5, 4, 2, 1.0)[0] == [-1, -1, 0]


def test_to_zero_reasons():
    target, why = to_zero(np.array([2.5, 2.4, -0.1, 0.0, 2.5, 4.5, 3.0, 1.0, 2.2, 0.0]), 2, 4, True)
    assert why[2] == "zero-cross" and why[5] == "stop"
    assert target[0] == -1 and target[2] == 0 and target[6] == 0 and target[8] == -1


def test_to_zero_time_stop():
    target, why = to_zero(np.array([2.5] + [1.0] * 8), 2, 4, False, 3)
    assert why.index("time-stop") == 4 and target[4] == 0


def test_bounded_orders_fill_a_row_later_and_close_at_the_end():
    side, why = bounded_orders(np.array([2.5, 2.0, 0.3, 0.0, 2.5, 2.5, 2.5, 2.5, 2.5]), 2, 0.5, 4, 60)
    assert side == [0, -1, -1, 0, 0, -1, -1, -1, -1] and why[2] == "target" and why[-1] == "end_of_window"


def test_bounded_orders_do_not_enter_beyond_the_stop():
    assert set(bounded_orders(np.full(20, 5.0), 2, 0.5, 4, 60)[0]) == {0}


@pytest.mark.parametrize("base, cap, expected", [([0.6, 0.3, 0.1], 0.5, [0.5, 0.375, 0.125]), ([0, 0, 0], 0.5, [1 / 3] * 3), ([1, 0, 0], 0.5, [0.5, 0.25, 0.25]), ([1, 1], 0.3, [0.3, 0.3]), ([], 0.5, [])])
def test_capped_weights(base, cap, expected):
    from spreadworks.functions.stats import capped_weights

    assert capped_weights(base, cap) == pytest.approx(expected)
