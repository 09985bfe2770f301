"""Closed-form tail probabilities as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def p_valor_pendiente(r2: Column, n: Column) -> Column:
    """Two-sided p-value of a regression slope from r squared and the point count.

    Student's t with ``n - 2`` degrees of freedom has a finite trigonometric series
    (Abramowitz & Stegun 26.7.3-4); its terms are folded with ``aggregate``, so the
    value stays inside the JVM.  Meant for yearly series, where ``n`` is small.
    """
    nu = (n - 2).cast("int")
    t = F.sqrt(F.when(r2 < 1, r2 / (1 - r2))) * F.sqrt(nu.cast("double"))
    theta = F.atan2(t, F.sqrt(nu.cast("double")))
    sen, cos = F.sin(theta), F.cos(theta)
    impar = nu % 2 == 1
    ultimo = F.when(impar, (nu - 3) / 2).otherwise((nu - 2) / 2).cast("int")

    # Fold over j = 0..ultimo, keeping (sum, coefficient, power of cos).
    inicio = F.struct(
        F.lit(0.0).alias("s"), F.lit(1.0).alias("c"), F.when(impar, cos).otherwise(1.0).alias("p")
    )

    def paso(acc, j):
        razon = F.when(impar, (2 * j + 2) / (2 * j + 3)).otherwise((2 * j + 1) / (2 * j + 2))
        return F.struct(
            (acc["s"] + acc["c"] * acc["p"]).alias("s"),
            (acc["c"] * razon).alias("c"),
            (acc["p"] * cos * cos).alias("p"),
        )

    indices = F.when(ultimo >= 0, F.sequence(F.lit(0), ultimo)).otherwise(F.array().cast("array<int>"))
    serie = F.aggregate(indices, inicio, paso, lambda a: a["s"])
    dos_pi = F.lit(2.0) / F.pi()
    p_impar = F.lit(1.0) - dos_pi * (theta + F.when(nu > 1, sen * serie).otherwise(0.0))
    p_par = F.lit(1.0) - sen * serie
    return (
        F.when(nu < 1, F.lit(None).cast("double"))
        .when(r2 >= 1, F.lit(0.0))
        .otherwise(F.when(impar, p_impar).otherwise(p_par))
    )


def jarque_bera(n: Column, asimetria: Column, curtosis: Column) -> Column:
    return n / F.lit(6.0) * (asimetria * asimetria + curtosis * curtosis / F.lit(4.0))


def p_jarque_bera(jb: Column) -> Column:
    """Exact chi-square tail with two degrees of freedom."""
    return F.exp(-jb / F.lit(2.0))


def _polinomio(x: Column, coeficientes: Sequence[float]) -> Column:
    """Coefficients from the highest power down."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coeficientes[1:], F.lit(coeficientes[0]))


# Abramowitz & Stegun 7.1.26 for the error function, to 1.5e-7.
ERF_P, ERF_A = 0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)

# Tail of the Lilliefors statistic, Dallal & Wilkinson (1986) below 0.1 and
# Stephens' fit of the modified statistic above: (largest value, coefficients from the highest power down).
LILLIEFORS_COLAS = (
    (0.5, (81.218052, -138.55152, 80.709644, -19.828315, 2.76773)),
    (0.9, (-32.355711, 94.029866, -97.490286, 40.662806, -4.901232)),
    (1.31, (2.423045, -12.234627, 23.186922, -19.558097, 6.198765)),
)


def normal_acumulada(z: Column) -> Column:
    """Distribution function of the standard normal."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    erf = F.lit(1.0) - _polinomio(t, ERF_A) * t * F.exp(-x * x)
    return F.lit(0.5) + F.lit(0.5) * F.when(z < 0, -erf).otherwise(erf)


def p_lilliefors(d: Column, n: Column) -> Column:
    """Approximate tail of the Kolmogorov-Smirnov distance to a normal with fitted mean and deviation."""
    nd = F.least(n.cast("double"), F.lit(100.0))
    dd = F.when(n > 100, d * F.pow(n / F.lit(100.0), F.lit(0.49))).otherwise(d)
    m = nd + F.lit(2.78019)
    p = F.exp(
        F.lit(-7.01256) * dd * dd * m + F.lit(2.99587) * dd * F.sqrt(m) - F.lit(0.122119)
        + F.lit(0.974598) / F.sqrt(nd) + F.lit(1.67997) / nd
    )
    raiz = F.sqrt(n.cast("double"))
    k = (raiz - F.lit(0.01) + F.lit(0.85) / raiz) * d
    cola = F.when(k <= 0.302, F.lit(1.0))
    for tope, coeficientes in LILLIEFORS_COLAS:
        cola = cola.when(k <= tope, _polinomio(k, coeficientes))
    return F.when(p > 0.1, cola.otherwise(F.lit(0.0))).otherwise(p)
