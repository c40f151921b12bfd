"""Rolling quantiles whose value is a short decimal."""

import numpy as np
import pytest

from tidebars.operators.features import rolling_quantiles


@pytest.mark.parametrize(("window", "low", "high"), [(20, 2000.0, 2050.0), (30, 2000.0, 2050.0), (40, 2000.0, 2020.0), (60, 1974.0, 1984.0)])
def test_a_quantile_that_is_a_whole_number_is_that_number(window, low, high):
    """A last bit more, and a close that is exactly 12 % below the base counts as further away."""
    under = (window - 1) * 9 // 10
    closes = np.array([1500.0] * under + [low] + [high] * (window - under - 1))
    assert rolling_quantiles(closes, window, (0.9,))[0, 0] == low + (high - low) / 10


def test_a_quantile_of_equal_closes_is_the_close():
    closes = np.full(80, 1973.0)
    assert (rolling_quantiles(closes, 60) == 1973.0).all()
