"""The lifetime likelihoods cost gamma functions per distinct frequency, not per customer."""

import math

import numpy as np
import pytest

from stayflow.operators import lifetime


@pytest.mark.parametrize("kind", ["purchases", "spends"])
def test_gamma_functions_per_distinct_frequency(monkeypatch, kind):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 3000).astype(float)
    recency, age, mean = rng.uniform(0, 10, 3000), rng.uniform(10, 20, 3000), np.where(x > 0, rng.uniform(1, 9, 3000), 0.0)
    sizes, plain = [], lifetime.log_gamma
    monkeypatch.setattr(lifetime, "log_gamma", lambda v: sizes.append(np.size(v)) or plain(v))
    lg = np.vectorize(math.lgamma)
    if kind == "purchases":
        r, alpha, a, b = theta = np.array([0.8, 4.0, 0.6, 2.4])
        got = lifetime.purchase_likelihood(theta, x, recency, age)
        gone = np.where(x > 0, np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + recency), -np.inf)
        want = lg(r + x) - lg(r) + r * np.log(alpha) + lg(a + b) + lg(b + x) - lg(b) - lg(a + b + x) + np.logaddexp(-(r + x) * np.log(alpha + age), gone)
    else:
        p, q, v = theta = np.array([2.0, 3.0, 1.0])
        got = lifetime.spend_likelihood(theta, x, mean)
        n, m = np.maximum(x, 1), np.where(x > 0, mean, 1.0)
        want = np.where(x > 0, lg(p * n + q) - lg(p * n) - lg(q) + q * np.log(v) + (p * n - 1) * np.log(m) + p * n * np.log(n) - (p * n + q) * np.log(v + m * n), 0.0)
    assert np.allclose(got, want, atol=1e-9) and max(sizes) <= 5
