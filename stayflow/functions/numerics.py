"""Distribution functions for statistics that are already aggregated."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_sf(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def kolmogorov_sf(d: float, n1: int, n2: int) -> float:
    """The asymptotic two-sample p-value of a distance."""
    t = d * math.sqrt(n1 * n2 / (n1 + n2))
    if t < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def e_value(rr: float) -> float:
    """The least strength of association that explains a risk ratio away."""
    r = rr if rr >= 1 else 1 / rr
    return r + math.sqrt(r * (r - 1))
