import math

import pytest

from datalumen.functions import distributions as d


@pytest.mark.parametrize("t, df, p", [(0.312207, 14.547650, 0.759313), (1.431419, 20.709782, 0.167229), (12.706204736, 1, 0.05),
                                      (1.959963985, 1e9, 0.05), (0.0, 5, 1.0)])
def test_t(t, df, p):
    assert d.t_two_sided(t, df) == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize("x, df, p", [(7.370370, 9, 0.598618), (2.048993, 2, 0.358977), (3.841458821, 1, 0.05), (0, 3, 1.0)])
def test_chi2(x, df, p):
    assert d.chi2_upper(x, df) == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize("f, a, b, p", [(12.483625, 3, 21, 6.66284e-05), (2.869663, 3, 21, 0.060772), (4.0, 2, 10, (1 + 8 / 10) ** -5)])
def test_f(f, a, b, p):
    assert d.f_upper(f, a, b) == pytest.approx(p, rel=1e-4)


def test_even_chi2_has_a_closed_form():
    for x in (0.3, 4.0, 25.0, 90.0):
        assert d.chi2_upper(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
    poisson = sum(math.exp(-250 + i * math.log(250) - math.lgamma(i + 1)) for i in range(200))
    assert d.chi2_upper(500.0, 400) == pytest.approx(poisson, rel=1e-9)


@pytest.mark.parametrize("df, point", [(1, 12.706204736), (24, 2.063898562), (1000, 1.962339081)])
def test_t_quantile(df, point):
    assert d.t_quantile(0.975, df) == pytest.approx(point, rel=1e-8)


def test_interval_of_a_known_sample():
    assert d.t_quantile(0.975, 24) * 488.435161169491 / 5 == pytest.approx(201.616125, abs=1e-5)


@pytest.mark.parametrize("t", [0.5, 1.96, 5.0, 8.0])
def test_tails_keep_their_digits_with_many_rows(t):
    normal = math.erfc(t / math.sqrt(2))
    assert d.t_two_sided(t, 1e12) == pytest.approx(normal, rel=1e-9)
    assert d.f_upper(t * t, 1.0, 1e15) == pytest.approx(normal, rel=1e-9)
    below, above = d.MANY * 0.999, d.MANY * 1.001
    assert d.t_two_sided(t, below) == pytest.approx(d.t_two_sided(t, above), rel=1e-6)
    assert d.f_upper(t, 7.0, below) == pytest.approx(d.f_upper(t, 7.0, above), rel=1e-6)
