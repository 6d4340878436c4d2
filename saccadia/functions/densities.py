"""Response kernels, densities and the transform between bounded and unbounded values, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def response_kernel(t: Column, npar: Column | float = 10.1, tmax: Column | float = 930.0) -> Column:
    """Erlang-gamma pupil response to an event at 0 ms, 1 at its peak tmax; 0 before."""
    npar, tmax = (v if isinstance(v, Column) else F.lit(float(v)) for v in (npar, tmax))
    u = t / tmax
    return F.when(t > 0, F.pow(u, npar) * F.exp(npar * (1 - u))).otherwise(0.0)


def asymmetric_laplace(y: Column, mu: float, sigma: float, tau: float) -> Column:
    """Density with location mu, scale sigma and the share tau of it (0 to 1) below mu."""
    below, above = (1 - tau) * (mu - y), tau * (y - mu)
    return 2 * tau * (1 - tau) / sigma * F.exp(-2 / sigma * F.when(y <= mu, below).otherwise(above))


def asymmetric_laplace_kappa(y: Column, mu: float, lam: float, kappa: float) -> Column:
    """Density with location mu, rate lam and asymmetry kappa (1: symmetric)."""
    return lam / (kappa + 1 / kappa) * F.exp(F.when(y <= mu, lam / kappa * (y - mu)).otherwise(-lam * kappa * (y - mu)))


def unbounded(x: Column, a: float = -math.inf, b: float = math.inf) -> Column:
    """Values of [a, b] on the whole line: log distance from one bound, log odds between two."""
    tiny = F.lit(1e-15)
    if a > -math.inf and b < math.inf:
        return -F.log((b - a) / (x - a) - 1)
    if a > -math.inf:
        return F.log(F.greatest(x - a, tiny))
    return F.log(F.greatest(b - x, tiny)) if b < math.inf else x


def bounded(x: Column, a: float = -math.inf, b: float = math.inf) -> Column:
    """The inverse of `unbounded`."""
    if a > -math.inf and b < math.inf:
        return 1 / (1 + F.exp(-x)) * (b - a) + a
    if a > -math.inf:
        return F.exp(x) + a
    return b - F.exp(x) if b < math.inf else x
