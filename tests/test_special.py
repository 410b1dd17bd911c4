import math

import pytest

from cohortspark.functions import special as s
from cohortspark.operators import privacy


def test_known_values():
    assert s.norm_quantile(0.975) == pytest.approx(1.959963984540054)
    assert s.chisq_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert s.chisq_quantile(0.95, 10) == pytest.approx(18.307038053275146)
    assert s.t_quantile(0.975, 5) == pytest.approx(2.5705818356363146)
    assert s.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert s.beta_quantile(0.025, 3, 8) == pytest.approx(0.06673951117773447)
    assert s.gamma_quantile(0.5, 1) == pytest.approx(math.log(2))
    assert s.digamma(1) == pytest.approx(-0.5772156649015329) and s.trigamma(1) == pytest.approx(math.pi**2 / 6)
    assert s.clopper_pearson(0, 10, 0.05) == (0.0, pytest.approx(0.3084971078187608))
    assert s.garwood(0, 0.05) == (0.0, pytest.approx(3.6888794541139363))


@pytest.mark.parametrize("p", [0.3, 0.7, 0.9])
def test_noise_tails_by_summation(p):
    q = (1 - p) / (1 + p)
    pmf = lambda k: q * p ** abs(k)
    for r in (0, 2, 7):
        one = sum(pmf(k) for k in range(-400, 401) if abs(k) > r)
        assert math.exp(privacy.log_tail(p, r)) == pytest.approx(one, rel=1e-6)
        two = sum(pmf(j) * pmf(k - j) for k in range(-120, 121) if abs(k) > r for j in range(-250, 251))
        assert math.exp(privacy.log_tail(p, r, 2)) == pytest.approx(two, rel=1e-3)


def test_radius_and_sigma():
    p = privacy.geometric_scale(1.0, 2.0)
    r = privacy.accuracy_radius(p, 12)
    assert privacy.log_tail(p, r) <= math.log(0.05 / 12) < privacy.log_tail(p, r - 1)
    sigma = privacy.gaussian_sigma(1.0, 1e-5)
    spent = s.norm_cdf(0.5 / sigma - sigma) - math.e * s.norm_cdf(-0.5 / sigma - sigma)
    assert spent == pytest.approx(1e-5, rel=1e-4)
