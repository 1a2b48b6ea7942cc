"""Two-sided Student-t p-value of a Pearson correlation, as a pure Column expression.

With nu = n - 2 degrees of freedom and cos(theta)^2 = 1 - r^2, p is the share of the integral of
cos(phi)^(nu - 1) over [0, pi/2] that lies above theta. Setting cos(phi) = exp(-z^2 / (2 nu)) makes the
integrand a Gaussian times a smooth factor that is nearly 1:

  exp(-z^2 / 2) * g(z / sqrt(nu)),   g(y) = y / sqrt(1 - exp(-y^2)),   from z0 = sqrt(-nu ln(1 - r^2))

Both integrals (from z0 and from 0) are taken by one Gauss-Legendre rule of ``NODES`` points over a range of
``REACH``, past which a Gaussian is below 1e-17. The work is the same for every n, and no gamma function is needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES, REACH = 64, 9.0


def _rule() -> tuple[str, str]:
    """SQL arrays of the nodes and of the weights times the Gaussian at the node."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    x, w = (x + 1) * REACH / 2, w * REACH / 2 * np.exp(-((x + 1) * REACH / 2) ** 2 / 2)
    return tuple(f"array({', '.join(f'{v:.17e}D' for v in a)})" for a in (x, w))


def p_value_expr(r: str, n: str) -> str:
    """Spark SQL text of the p-value for correlation column ``r`` over ``n`` pairs."""
    x, w = _rule()
    nu = f"CAST({n} - 2 AS DOUBLE)"
    start = f"sqrt(-{nu} * log1p(-least({r} * {r}, 1D - 1e-16D)))"

    def area(z0: str) -> str:
        """Integral from ``z0``, without the factor exp(-z0^2 / 2)."""
        y2 = f"(({z0} + x) * ({z0} + x) / {nu})"
        return (f"aggregate(zip_with({x}, {w}, (x, w) -> w * exp(-{z0} * x) * sqrt({y2} / -expm1(-{y2}))), "
                f"0D, (a, v) -> a + v)")

    share = f"exp(-{start} * {start} / 2) * {area(start)} / {area('0D')}"
    return (f"CASE WHEN {r} IS NULL OR {n} IS NULL OR {n} <= 2 THEN NULL WHEN abs({r}) >= 1D THEN 0D "
            f"ELSE least(1D, greatest(0D, {share})) END")


def p_value(r: str, n: str) -> Column:
    return F.expr(p_value_expr(r, n))


def t_stat(r: str, n: str) -> Column:
    """t statistic; NULL for n <= 2 and for |r| = 1 (infinite t)."""
    return F.expr(f"CASE WHEN {n} > 2 AND abs({r}) < 1D THEN {r} * sqrt(({n} - 2) / (1D - {r} * {r})) END")


# DuckDB text of the same p-value by an independent closed form (log-gamma terms).
def p_value_duck(r: str, n: str) -> str:
    nu = f"({n} - 2)"
    theta = f"atan2(abs({r}), sqrt(greatest(0.0, 1.0 - {r} * {r})))"
    ct = f"cos({theta})"
    even_sum = (f"list_sum(list_transform(range(2, {nu} - 1, 2), lambda k: exp(lgamma((k + 1) / 2.0) - lgamma(k / 2.0 + 1)) "
                f"* pow({ct}, k) / sqrt(pi())))")
    odd_sum = (f"list_sum(list_transform(range(3, {nu} - 1, 2), lambda k: exp(lgamma((k + 1) / 2.0) - lgamma(k / 2.0 + 1)) "
               f"* (sqrt(pi()) / 2.0) * pow({ct}, k - 1)))")
    a_val = (f"CASE WHEN {nu} = 1 THEN 2.0 * {theta} / pi() "
             f"WHEN {nu} % 2 = 0 THEN sin({theta}) * (1.0 + coalesce({even_sum}, 0.0)) "
             f"ELSE 2.0 / pi() * ({theta} + sin({theta}) * {ct} * (1.0 + coalesce({odd_sum}, 0.0))) END")
    return (f"CASE WHEN {r} IS NULL OR {n} IS NULL OR {n} <= 2 THEN NULL "
            f"ELSE least(1.0, greatest(0.0, 1.0 - ({a_val}))) END")
